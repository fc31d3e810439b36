"""Secret scans with DataFrame functions only.

Base detectors are regular expressions. On top of them, two character Markov chains (random strings against ordinary
identifiers) are trained from labelled samples, and long tokens whose mean log-likelihood ratio is high are reported as
``random``.

Defined results: a null text is empty and has no spans; an empty table gives an empty table; repeated rows are each
scanned; other columns are left alone; with no labelled ordinary samples the chain falls back to its smoothing.
Positions are code points, the end is exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # runs are maximal, so the length can stand in the pattern
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
WIDTH = len(ALPHABET) + 1  # 0 stands for any other character
#: Mean log-likelihood ratio (nats a transition) from which a token counts as random.
MIN_RATIO = 0.5
#: Bounds of the labelled sample: documents that words are taken from, and strings made of each random kind.
SAMPLE_DOCS, SAMPLE_STRINGS = 2000, 1000

_SPAN = "array<struct<start:int,kind:int,stop:int>>"
_FOUND = "array<struct<start:int,kind:int,stop:int,token:string>>"
#: Elements folded one by one in _running, and characters of a piece that redact() cuts from.
_BLOCK, _PIECE = 64, 512
_FAR = 2**31 - 1


def _with(value: Column, use) -> Column:
    """What use makes of a value that is computed once, however often a lambda mentions it."""
    return F.transform(F.array(value), use)[0]


def _running(values: Column, zero: int, op) -> Column:
    """Fold of each prefix of an array of integers, in blocks: nothing is folded or copied once for each element before it."""
    fold = lambda part: F.aggregate(part, F.lit(zero), op)
    count = lambda v: F.ceil(F.size(v) / _BLOCK).cast("int")

    def joined(v, blocks):
        own = lambda b: F.slice(v, b * _BLOCK + 1, _BLOCK)
        inner = lambda b: _with(F.struct(own(b).alias("x"), fold(F.slice(blocks, F.lit(1), b)).alias("z")), lambda r: F.transform(r["x"], lambda _, j: op(r["z"], fold(F.slice(r["x"], F.lit(1), j + 1)))))
        return F.flatten(F.transform(F.sequence(F.lit(0), count(v) - 1), inner))

    blocks = lambda v: F.transform(F.sequence(F.lit(0), count(v) - 1), lambda b: fold(F.slice(v, b * _BLOCK + 1, _BLOCK)))
    done = _with(values, lambda v: F.when(F.size(v) > 0, _with(F.struct(v.alias("v"), blocks(v).alias("b")), lambda r: joined(r["v"], r["b"]))))
    return F.coalesce(done, F.array().cast("array<int>"))


def _found(text: Column, pattern: str, kind: int, value: int | None = None, least: int = 0) -> Column:
    """Spans of a pattern's leftmost non-overlapping matches, with what matched; with value, only those whose group is long enough."""
    every = lambda group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), every(0).alias("hits"), *([every(value).alias("values")] if value is not None else []))

    def spans(f):
        sizes = F.zip_with(F.slice(f["gaps"], F.lit(1), F.size(f["hits"])), f["hits"], lambda g, h: F.char_length(g) + F.char_length(h))
        each = lambda stops: F.transform(f["hits"], lambda h, i: F.struct((F.get(stops, i) - F.char_length(h)).alias("start"), F.lit(kind).alias("kind"), F.get(stops, i).alias("stop"), h.alias("token")))
        got = _with(_running(sizes, 0, lambda x, y: x + y), each)
        return got if value is None else F.filter(got, lambda _, i: F.char_length(F.get(f["values"], i)) >= least)

    return F.when(text.rlike(pattern), _with(found, spans)).otherwise(F.array().cast(_FOUND))


def _bare(found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))


def base_spans(text: Column) -> Column:
    return _bare(F.concat(_found(text, ASSIGN, 0, 2, 6), _found(text, ACCESS, 1), _found(text, HEX, 2)))


def labelled_samples(docs: DataFrame, text: str = "text", id_col: str = "doc_id", max_docs: int = SAMPLE_DOCS, strings: int = SAMPLE_STRINGS) -> DataFrame:
    """(token, label): 1 for random strings, 0 for ordinary identifiers.

    Random: what the base detectors find in a sample of at most max_docs documents (the ones with the smallest hashed
    ids) and ``strings`` made of each usual form. Ordinary: the other words of those documents, and plain numbers.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).alias("__id")).where("__id is not null").orderBy(F.xxhash64("__id"), "__id").limit(max_docs)
    some = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__t")).join(F.broadcast(ids.distinct()), "__id", "left_semi")  # at most max_docs ids
    hits = some.select(F.explode(F.concat(F.regexp_extract_all("__t", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("__t", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("__t", F.lit(HEX), F.lit(0)))).alias("token")).where(F.char_length("token") >= 12)
    rest = F.regexp_replace(F.regexp_replace("__t", ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    words = some.select(F.explode(F.regexp_extract_all(rest, F.lit(r"[A-Za-z0-9+/_=-]+"), F.lit(0))).alias("token"))
    digest = lambda salt: F.unhex(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256))
    made = spark.range(strings).select(F.explode(F.array(
        F.regexp_replace(F.base64(digest("a")), "[\\r\\n=]", ""),
        F.lower(F.substring(F.hex(digest("b")), 1, 40)),
        F.translate(F.substring(F.base64(digest("c")), 1, 20), "abcdefghijklmnopqrstuvwxyz+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ01"),
    )).alias("token"))
    numbers = spark.range(strings).select(F.translate(F.substring(F.hex(digest("d")), 1, 20), "ABCDEF", "012345").alias("token"))
    one, none = F.lit(1).alias("label"), F.lit(0).alias("label")
    return hits.unionByName(made).select("token", one).unionByName(words.unionByName(numbers).select("token", none))


def _codes(token: Column) -> Column:
    """Place of each character in ALPHABET, 0 for others."""
    places = F.from_json(F.lit(str([ALPHABET.find(chr(c)) + 1 for c in range(128)])), "array<int>")
    return F.transform(F.split(token, ""), lambda c: F.coalesce(F.get(places, F.ascii(c)), F.lit(0)))


def _transitions(codes: Column) -> Column:
    return F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: a * WIDTH + b)


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratio of each transition, at most WIDTH x WIDTH numbers, from counts made on Spark."""
    pairs = samples.where(F.char_length("token") >= 2).select("label", F.explode(_with(_codes(F.col("token")), _transitions)).alias("code"))
    n = [[0.0] * WIDTH * WIDTH for _ in range(2)]
    for label, code, count in pairs.groupBy("label", "code").count().collect():  # two small matrices
        n[label][code] += count
    ratio = []
    for a in range(WIDTH):
        row = slice(a * WIDTH, (a + 1) * WIDTH)
        whole = [sum(x[row]) + smoothing * WIDTH for x in n]
        ratio += [round(math.log((r + smoothing) / whole[1]) - math.log((o + smoothing) / whole[0]), 3) for o, r in zip(n[0][row], n[1][row], strict=True)]
    return ratio


def ratio_of(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's transitions."""
    numbers = F.from_json(F.lit(str(model)), "array<double>")
    total = F.aggregate(_with(_codes(token), _transitions), F.lit(0.0), lambda acc, code: acc + F.get(numbers, code))
    return total / (F.char_length(token) - 1)


def _chosen(found: Column, model: list[float], min_ratio: float) -> Column:
    """Base spans and those random tokens that overlap none of them, from all in order: a token is free if the base spans that
    start before it have ended, and the next one starts after it."""
    before = _running(F.transform(found, lambda s: F.when(s["kind"] < 3, s["stop"]).otherwise(0)), 0, lambda x, y: F.greatest(x, y))
    after = _running(F.transform(F.reverse(found), lambda s: F.when(s["kind"] < 3, s["start"]).otherwise(_FAR)), _FAR, lambda x, y: F.least(x, y))
    return _with(F.struct(before.alias("b"), F.reverse(after).alias("a")), lambda near: F.filter(found, lambda s, i: F.when(s["kind"] < 3, True).when((F.get(near["b"], i) <= s["start"]) & (F.get(near["a"], i) >= s["stop"]), ratio_of(s["token"], model) >= min_ratio).otherwise(False)))


def scan(docs: DataFrame, model: list[float], text: str = "text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """docs with __base and __spans: arrays of (start, kind as index of KINDS, stop) in order of start, then kind. The work
    follows the length of a text, also where it holds very many spans or one very long token."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumn("__base", F.array_sort(base_spans(t))).withColumn("__more", _found(t, TOKEN, 3))
    known = F.transform("__base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), F.lit(None).cast("string").alias("token")))
    chosen = _bare(_with(F.array_sort(F.concat(known, "__more")), lambda every: _chosen(every, model, min_ratio)))
    return found.withColumn("__spans", F.when(F.size("__more") > 0, chosen).otherwise(F.col("__base"))).drop("__more")


def listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(found: DataFrame, text: str = "text", by: str = "[SECRET]") -> DataFrame:
    """Replaces the spans of scan() in the text; overlapping spans are one."""
    t = F.coalesce(F.col(text), F.lit(""))

    def part(pieces, a, b):
        """Characters a to b of the text, from its pieces."""
        i, j = F.floor(a / _PIECE).cast("int"), F.floor(b / _PIECE).cast("int")
        own = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
        several = F.concat(F.substring(own(i), a % _PIECE + 1, F.lit(_PIECE)), F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(own(j), F.lit(1), b % _PIECE))
        return F.when(i == j, F.substring(own(i), a % _PIECE + 1, b - a)).otherwise(several)

    def replaced(r):
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(r["stops"], i - 1))
        each = F.transform(r["spans"], lambda s, i: F.when(s["start"] >= before(i), F.concat(part(r["pieces"], before(i), s["start"]), F.lit(by))).otherwise(""))
        return F.concat(F.array_join(each, ""), part(r["pieces"], F.element_at(r["stops"], -1), r["n"]))

    stops = _running(F.transform("__spans", lambda s: s["stop"]), 0, lambda x, y: F.greatest(x, y))
    row = F.struct(F.regexp_extract_all(t, F.lit("(?s).{1,%d}" % _PIECE), F.lit(0)).alias("pieces"), stops.alias("stops"), F.col("__spans").alias("spans"), F.char_length(t).alias("n"))
    return found.withColumn(text, F.when(F.size("__spans") > 0, _with(row, replaced)).otherwise(F.col(text)))
