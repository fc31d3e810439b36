"""Queries over the driver's tables, each with its equivalent in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import binary, bulk, exact, logic, numbers, regex, text
from .functions.terms import captured, num_col, number, staged, strict, text_col
from .functions.terms import as_text as _text
from .operators import lifted, lists
from .plans.ruleset import RuleSet
from .sources import ingest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MONEY = (15, 2)


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str, money: tuple[str, ...] = ()) -> DataFrame:
    return ingest.exact(ingest.read(spark, f"{sf_dir}/{name}.parquet"), {c: MONEY for c in money})


def money(name: str):
    return num_col(name, *MONEY)


def shown(x) -> F.Column:
    """A result as its canonical text."""
    return strict(_text(x))


_LINES = "SELECT *, CAST(l_quantity AS DECIMAL(15,2)) AS qty, CAST(l_extendedprice AS DECIMAL(15,2)) AS price, CAST(l_discount AS DECIMAL(15,2)) AS disc, CAST(l_tax AS DECIMAL(15,2)) AS tax FROM lineitem"
_ORDERS = "SELECT *, CAST(o_totalprice AS DECIMAL(15,2)) AS total FROM orders"
_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _lines(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lineitem", ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))


def qty():
    return money("l_quantity")


def price():
    return money("l_extendedprice")


def disc():
    return money("l_discount")


def tax():
    return money("l_tax")


# flagship: an order rule over orders and their lines

_TOTALS = f"""
WITH l AS ({_LINES}), o AS ({_ORDERS}), t AS (
  SELECT l_orderkey, sum(qty * price) AS total_lines, count(*) AS n, count(*) FILTER (WHERE qty <= 0) AS empty_lines FROM l GROUP BY 1
)
SELECT o_orderkey, CAST(coalesce(n, 0) AS BIGINT) AS n_lines,
  CASE WHEN coalesce(n, 0) = 0 THEN 'the order has no lines'
       WHEN empty_lines > 0 THEN CAST(empty_lines AS VARCHAR) || ' line(s) have no quantity'
       WHEN total_lines > total THEN 'total ' || CAST(total_lines AS VARCHAR) || ' exceeds the credit limit of ' || CAST(total AS VARCHAR)
       ELSE 'ok' END AS message
FROM o LEFT JOIN t ON l_orderkey = o_orderkey
"""


def order_rule(n, empty_lines, total, limit):
    return logic.cond(
        n == 0, "the order has no lines",
        empty_lines > 0, logic.concat(empty_lines, " line(s) have no quantity"),
        total > limit, logic.concat("total ", total, " exceeds the credit limit of ", limit),
        "ok",
    )


@query(_TOTALS)
def order_rule_lifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule with its aggregates lifted onto the child table."""
    orders = read(spark, sf_dir, "orders", ("o_totalprice",)).select("o_orderkey", "o_totalprice")
    lines = _lines(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey")
    joined, t = lifted.attach(orders, lines, "o_orderkey", {"total": lifted.sum_(qty() * price()), "n": lifted.count(), "empty": lifted.count(qty() <= 0)})
    rule = order_rule(t["n"], t["empty"], t["total"], money("o_totalprice"))
    return joined.select("o_orderkey", strict(t["n"]).cast("long").alias("n_lines"), strict(rule).alias("message"))


_ITEM = lists.records({"l_quantity": lambda c: num_col(c, *MONEY), "l_extendedprice": lambda c: num_col(c, *MONEY), "l_linenumber": lambda c: num_col(c.cast("decimal(10,0)"), 10, 0)})


def _nested(spark, sf_dir) -> DataFrame:
    orders = read(spark, sf_dir, "orders", ("o_totalprice",)).select("o_orderkey", "o_totalprice")
    lines = _lines(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey")
    return ingest.nested(orders, lines, "o_orderkey", "ITEMS", ["l_quantity", "l_extendedprice", "l_linenumber"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])


@query(_TOTALS)
def order_rule_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rule over nested lists."""
    items = lists.list_col("ITEMS", _ITEM)
    total = lists.sum_(items, lambda i, k: i["l_quantity"] * i["l_extendedprice"])
    empty = lists.count(lists.filter_(items, lambda i, k: i["l_quantity"] <= 0))
    nested, t = staged(_nested(spark, sf_dir), {"n": lists.count(items), "empty": empty, "total": total})
    rule = order_rule(t["n"], t["empty"], t["total"], money("o_totalprice"))
    return nested.select("o_orderkey", strict(t["n"]).cast("long").alias("n_lines"), strict(rule).alias("message"))


# arithmetic, comparison, control


@query(f"SELECT {_KEY}, CAST(qty * price AS VARCHAR) AS product, CAST(price - disc AS VARCHAR) AS difference, CAST(price * (1 - disc) * (1 + tax) AS VARCHAR) AS charge, CAST(-price AS VARCHAR) AS negative, CAST(price % (qty + 1) AS VARCHAR) AS rest FROM ({_LINES})")
def arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = {"product": qty() * price(), "difference": price() - disc(), "charge": price() * (1 - disc()) * (1 + tax()), "negative": -price(), "rest": price() % (qty() + 1)}
    return _lines(spark, sf_dir).select(*_KEY.split(", "), *(shown(t).alias(n) for n, t in cols.items()))


@query(f"SELECT {_KEY}, CAST(round(price, 1) AS VARCHAR) AS r1, CAST(floor(price) AS VARCHAR) AS fl, CAST(ceil(price) AS VARCHAR) AS ce, CAST(abs(qty - 25) AS VARCHAR) AS ab, CAST(sign(qty - 25) AS VARCHAR) AS sg, CAST(trunc(price) AS VARCHAR) AS tr, CAST(qty * qty * qty AS VARCHAR) AS cube FROM (SELECT * REPLACE (CAST(qty AS DECIMAL(10,2)) AS qty) FROM ({_LINES}))")
def number_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = numbers
    cols = {"r1": n.round_(price(), 1), "fl": n.floor(price()), "ce": n.ceil(price()), "ab": n.abs_(qty() - 25), "sg": n.sign(qty() - 25), "tr": n.trunc(price()), "cube": n.power(qty(), 3)}
    return _lines(spark, sf_dir).select(*_KEY.split(", "), *(shown(t).alias(k) for k, t in cols.items()))


@query(f"SELECT {_KEY}, CAST(least(qty, disc * 100, tax * 1000) AS DOUBLE) AS low, CAST(greatest(qty, disc * 100, tax * 1000) AS DOUBLE) AS high FROM ({_LINES})")
def minimum_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = (qty(), disc() * 100, tax() * 1000)
    return _lines(spark, sf_dir).select(*_KEY.split(", "), strict(numbers.min_(*args)).cast("double").alias("low"), strict(numbers.max_(*args)).cast("double").alias("high"))


@query(f"SELECT {_KEY}, CAST((CAST(price * 100 AS BIGINT) * 20000 + CAST(qty * 100 AS BIGINT)) // (2 * CAST(qty * 100 AS BIGINT)) AS DOUBLE) / 10000 AS unit FROM ({_LINES})")
def division(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(*_KEY.split(", "), strict(numbers.round_(price() / qty(), 4)).cast("double").alias("unit"))


@query(f"SELECT {_KEY}, qty < 10 AS lt, qty <= 10 AS le, qty = 10 AS eq, qty <> 10 AS ne, qty >= 10 AS ge, qty > 10 AS gt, (qty < 10 AND disc > 0.05) OR NOT tax > 0.03 AS mixed, (qty < 25) <> (disc < 0.05) AS one FROM ({_LINES})")
def comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    five, three = number("0.05"), number("0.03")
    cols = {"lt": qty() < 10, "le": qty() <= 10, "eq": qty() == 10, "ne": qty() != 10, "ge": qty() >= 10, "gt": qty() > 10, "mixed": ((qty() < 10) & (disc() > five)) | ~(tax() > three), "one": (qty() < 25) ^ (disc() < five)}
    return _lines(spark, sf_dir).select(*_KEY.split(", "), *(strict(t).alias(n) for n, t in cols.items()))


@query(f"SELECT o_orderkey, CASE WHEN total > 200000 THEN 'large' WHEN total > 100000 THEN 'medium' ELSE 'small' END AS size, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE '' END AS state FROM ({_ORDERS})")
def control(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = money("o_totalprice")
    size = logic.cond(total > 200000, "large", total > 100000, "medium", "small")
    state = logic.if_(logic.text_eq(text_col("o_orderstatus"), "F"), "done")
    return read(spark, sf_dir, "orders", ("o_totalprice",)).select("o_orderkey", strict(size).alias("size"), strict(state).alias("state"))


@query("SELECT c_custkey, c_mktsegment = 'BUILDING' AS eq, c_mktsegment <> 'BUILDING' AS ne, c_mktsegment < 'FURNITURE' AS lt, c_mktsegment <= 'FURNITURE' AS le, c_mktsegment > 'FURNITURE' AS gt, c_mktsegment >= 'FURNITURE' AS ge, c_mktsegment IN ('BUILDING', 'MACHINERY') AS one_of, c_name || '/' || c_mktsegment AS label FROM customer")
def text_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = text_col("c_mktsegment")
    cols = {"eq": logic.text_eq(seg, "BUILDING"), "ne": logic.text_ne(seg, "BUILDING"), "lt": logic.text_lt(seg, "FURNITURE"), "le": logic.text_le(seg, "FURNITURE"), "gt": logic.text_gt(seg, "FURNITURE"), "ge": logic.text_ge(seg, "FURNITURE"), "one_of": logic.in_(seg, "BUILDING", "MACHINERY"), "label": logic.concat(text_col("c_name"), "/", seg)}
    return read(spark, sf_dir, "customer").select("c_custkey", *(strict(t).alias(n) for n, t in cols.items()))


# aggregates over lists


@query(f"""SELECT o_orderkey, coalesce(bool_and(qty > 1), true) AS every, coalesce(bool_or(qty >= 50), false) AS some, CAST(count(qty) FILTER (WHERE disc > 0.05) AS BIGINT) AS discounted,
  CAST(coalesce(sum(price) FILTER (WHERE disc > 0.05), 0) AS DOUBLE) AS discounted_price FROM orders LEFT JOIN ({_LINES}) ON l_orderkey = o_orderkey GROUP BY 1""")
def aggregates_lifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey")
    lines = _lines(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey")
    big = disc() > number("0.05")
    joined, t = lifted.attach(orders, lines, "o_orderkey", {"every": lifted.all_(qty() > 1), "some": lifted.any_(qty() >= 50), "n": lifted.count(big), "p": lifted.sum_(price(), big)})
    return joined.select("o_orderkey", strict(t["every"]).alias("every"), strict(t["some"]).alias("some"), strict(t["n"]).cast("long").alias("discounted"), strict(t["p"]).cast("double").alias("discounted_price"))


@query(f"""SELECT o_orderkey, coalesce(bool_and(qty > 1), true) AS every, coalesce(bool_or(qty >= 50), false) AS some,
  coalesce(string_agg(CAST(qty AS VARCHAR), ', ' ORDER BY l_linenumber, l_partkey, l_suppkey, qty, price) FILTER (WHERE qty > 20), '') AS large,
  coalesce((array_agg(CAST(qty AS VARCHAR) ORDER BY l_linenumber, l_partkey, l_suppkey, qty, price) FILTER (WHERE qty IS NOT NULL))[1], '-') AS first_quantity
FROM orders LEFT JOIN ({_LINES}) ON l_orderkey = o_orderkey GROUP BY 1""")
def aggregates_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested, t = staged(_nested(spark, sf_dir), {"items": lists.list_col("ITEMS", _ITEM)})
    items = t["items"]
    nested, t = staged(nested, {"filtered": lists.filter_(items, lambda i, k: i["l_quantity"] > 20), "every": lists.all_(items, lambda i, k: i["l_quantity"] > 1), "some": lists.any_(items, lambda i, k: i["l_quantity"] >= 50)})
    nested, mapped = staged(nested, {"mapped": lists.map_(t["filtered"], lambda i, k: i["l_quantity"])})
    first = logic.if_(lists.count(items) > 0, _text(items[1]["l_quantity"]), "-")
    cols = {"every": t["every"], "some": t["some"], "large": lists.join(mapped["mapped"], ", "), "first_quantity": first}
    return nested.select("o_orderkey", *(strict(t).alias(n) for n, t in cols.items()))


@query(f"""SELECT o_orderkey, coalesce(string_agg(CAST(qty AS VARCHAR), ', ' ORDER BY l_linenumber, l_partkey, l_suppkey, qty, price) FILTER (WHERE qty > 20), '') AS large
FROM orders LEFT JOIN ({_LINES}) ON l_orderkey = o_orderkey GROUP BY 1""")
def join_lifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey")
    lines = _lines(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    joined, t = lifted.attach(orders, lines, "o_orderkey", {"large": lifted.join(qty(), ", ", order, qty() > 20)})
    return joined.select("o_orderkey", strict(t["large"]).alias("large"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def in_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = read(spark, sf_dir, "orders").where(strict(logic.text_eq(text_col("o_orderstatus"), "F"))).select(F.col("o_custkey").alias("c_custkey"))
    return lifted.members(read(spark, sf_dir, "customer").select("c_custkey"), done, "c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def not_in_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = read(spark, sf_dir, "orders").where(strict(logic.text_eq(text_col("o_orderstatus"), "P"))).select(F.col("o_custkey").alias("c_custkey"))
    return lifted.members(read(spark, sf_dir, "customer").select("c_custkey"), have, "c_custkey", present=False)


# text


@query("""SELECT doc_id, CAST(length(text) AS BIGINT) AS n, left(text, 12) AS l, right(text, 12) AS r, substr(text, 5, 10) AS s, substr(text, 20) AS rest, CAST(instr(text, 'en') AS BIGINT) AS f, replace(text, 'en', '<>') AS rep,
  CASE WHEN text <> '' THEN CAST(unicode(text) AS BIGINT) END AS code, CASE WHEN text IS NULL THEN 'E_NOT_TEXT' WHEN text = '' THEN 'E_RANGE' END AS code_error, reverse(text) AS back FROM documents""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = text_col("text")
    n = {"n": text.len_(x), "f": text.find("en", x), "code": text.code(x)}
    s = {"l": text.left(x, 12), "r": text.right(x, 12), "s": text.substr(x, 5, 10), "rest": text.substr(x, 20), "rep": text.replace("en", "<>", x), "back": text.backwards(x)}
    return read(spark, sf_dir, "documents").select("doc_id", *(t.value.cast("long").alias(k) for k, t in n.items()), n["code"].error.alias("code_error"), *(t.value.alias(k) for k, t in s.items()))


@query("""SELECT p_partkey, translate(p_name, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS up, translate(p_type, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
  trim('  ' || p_brand || chr(9) || chr(10), ' ' || chr(9) || chr(13) || chr(10)) AS t, repeat(p_brand, 2) AS twice, CASE WHEN length(p_brand) >= 12 THEN p_brand ELSE lpad(p_brand, 12, '*-') END AS pl,
  CASE WHEN length(p_brand) >= 12 THEN p_brand ELSE rpad(p_brand, 12, '*-') END AS pr, chr(64 + CAST(p_size AS INTEGER) % 26 + 1) AS ch FROM part""")
def text_shaping(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand, size = text_col("p_brand"), num_col(F.col("p_size").cast("decimal(10,0)"), 10, 0, "p_size")
    cols = {"up": text.upper(text_col("p_name")), "low": text.lower(text_col("p_type")), "t": text.trim(logic.concat("  ", brand, "\t\n")), "twice": text.repeat(brand, 2), "pl": text.padl(brand, 12, "*-"), "pr": text.padr(brand, 12, "*-"), "ch": text.char(number(64) + size % 26 + 1)}
    return read(spark, sf_dir, "part").select("p_partkey", *(strict(t).alias(n) for n, t in cols.items()))


@query("SELECT p_partkey, CAST(len(string_split(p_name, ' ')) AS BIGINT) AS n, string_split(p_name, ' ')[1] AS one, array_to_string(list_reverse(string_split(p_name, ' ')), '|') IS NOT NULL AS ok, array_to_string(string_split(p_name, ' '), '|') AS bars FROM part")
def split_and_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.split(text_col("p_name"), " ")
    return read(spark, sf_dir, "part").select("p_partkey", strict(lists.count(words)).cast("long").alias("n"), strict(words[1]).alias("one"), strict(lists.has(words, "1")).alias("ok"), strict(lists.join(words, "|")).alias("bars"))


@query(r"SELECT page_id, regexp_matches(url, '^https://') AS secure, regexp_extract(url, '([0-9]+)(\.html)?$', 1) AS number, regexp_replace(url, '[0-9]+', '#', 'g') AS shape, CASE WHEN regexp_matches(url, '[0-9]') THEN CAST(length(regexp_extract(url, '^[^0-9]*')) + 1 AS BIGINT) ELSE 0 END AS at FROM pages WHERE url IS NOT NULL")
def regular_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = text_col("url")
    groups = regex.rgroups(r"(\d+)(\.html)?$", url)
    part = logic.if_(lists.count(groups) > 0, groups[2], "")
    return read(spark, sf_dir, "pages").where("url is not null").select("page_id", strict(regex.rmatch("^https://", url)).alias("secure"), strict(part).alias("number"), strict(regex.rreplace(r"\d+", "#", url)).alias("shape"), strict(regex.rfind(r"\d", url)).cast("long").alias("at"))


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n, lower(hex(encode(text))) AS hexed, base64(encode(text)) AS b64, CASE WHEN text IS NULL THEN 'E_NOT_TEXT' END AS code FROM documents")
def encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = text_col("text")
    n = binary.blen(x)
    return read(spark, sf_dir, "documents").select("doc_id", n.value.cast("long").alias("n"), binary.to_hex(x).value.alias("hexed"), binary.encode_base64(x).value.alias("b64"), n.error.alias("code"))


@query("SELECT doc_id, text AS round_hex, text AS round_b64, nullif(text, '') AS round_list, CASE WHEN text IS NULL THEN 'E_NOT_TEXT' WHEN text = '' THEN 'E_NO_SCALAR' END AS list_error, text AS round_xor FROM documents")
def round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoding undoes encoding: hexadecimal, base64, byte lists (one without elements has no bytes) and exclusive or."""
    x = text_col("text")
    back = binary.to_utf8(text.backwards(x))
    made = {"hex": binary.from_hex(binary.to_hex(x)), "b64": binary.decode_base64(binary.encode_base64(x)), "list": binary.ltb(binary.btl(x)), "xor": bulk.bxor(bulk.bxor(x, back), back)}
    docs, t = staged(read(spark, sf_dir, "documents"), made)
    return docs.select("doc_id", *(binary.from_utf8(v).value.alias(f"round_{n}") for n, v in t.items()), t["list"].error.alias("list_error"))


@query(None)
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32 of whole texts (DuckDB has none; tested against zlib)."""
    x = text_col("text")
    crc = binary.crc32(x)
    return read(spark, sf_dir, "documents").select("doc_id", crc.value.alias("crc"), crc.error.alias("code"))


# errors and rule sets


@query(f"SELECT {_KEY}, CASE WHEN qty = 25 THEN 'E_DIV_ZERO' END AS code, CASE WHEN qty = 25 THEN NULL ELSE CAST(round(100 / CAST(qty - 25 AS DOUBLE), 2) AS DOUBLE) END AS value FROM ({_LINES})")
def error_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = captured(numbers.round_(100 / (qty() - 25), 2))
    return _lines(spark, sf_dir).select(*_KEY.split(", "), c["error"].alias("code"), c["value"].cast("double").alias("value"))


@query(f"""SELECT {_KEY}, CAST(price * (1 - disc) AS VARCHAR) AS net, CAST(price * (1 - disc) * tax AS VARCHAR) AS due,
  CASE WHEN price * (1 - disc) * (1 + tax) > 50000 THEN 'gross ' || CAST(price * (1 - disc) + price * (1 - disc) * tax AS VARCHAR) ELSE '' END AS message FROM ({_LINES})""")
def rules_on_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that read results of rules before them."""
    rules = RuleSet({"net": price() * (1 - disc()), "due": lambda r: r["net"] * tax(), "gross": lambda r: r["net"] + r["due"], "message": lambda r: logic.if_(r["gross"] > 50000, logic.concat("gross ", r["gross"]), "")})
    lines, t = rules.staged(_lines(spark, sf_dir))
    return lines.select(*_KEY.split(", "), *(shown(t[n]).alias(n) for n in ("net", "due", "message")))


def form_rules() -> RuleSet:
    name, seg, bal = text_col("c_name"), text_col("c_mktsegment"), money("c_acctbal")
    return RuleSet({
        "name": logic.cond(text.is_blank(name), "a name is required", ~regex.rmatch(r"^Customer#\d+$", name), "a malformed name", ""),
        "balance": logic.if_(bal < 0, logic.concat("balance ", bal, " is negative"), ""),
        "segment": logic.if_(logic.in_(seg, "BUILDING", "MACHINERY"), "", logic.concat("segment ", text.lower(seg))),
    })


@query("""WITH c AS (SELECT *, CAST(c_acctbal AS DECIMAL(15,2)) AS bal FROM customer), m AS (
  SELECT 'name' AS rule, CASE WHEN trim(c_name, ' ' || chr(9) || chr(13) || chr(10)) = '' THEN 'a name is required' WHEN NOT regexp_matches(c_name, '^Customer#[0-9]+$') THEN 'a malformed name' ELSE '' END AS message FROM c
  UNION ALL SELECT 'balance', CASE WHEN bal < 0 THEN 'balance ' || CAST(bal AS VARCHAR) || ' is negative' ELSE '' END FROM c
  UNION ALL SELECT 'segment', CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN '' ELSE 'segment ' || lower(c_mktsegment) END FROM c)
SELECT rule, message, CAST(NULL AS VARCHAR) AS error, CAST(count(*) AS BIGINT) AS n FROM m WHERE message <> '' GROUP BY 1, 2""")
def rule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form_rules().summary(read(spark, sf_dir, "customer", ("c_acctbal",)))


@query("SELECT c_custkey FROM customer WHERE CAST(c_acctbal AS DECIMAL(15,2)) >= 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def rule_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = (money("c_acctbal") >= 0) & logic.in_(text_col("c_mktsegment"), "BUILDING", "MACHINERY")
    return RuleSet({"ok": ok}).where(read(spark, sf_dir, "customer", ("c_acctbal",)), "ok").select("c_custkey")


@query(f"""SELECT o_orderkey, CAST(1 + coalesce(sum(qty * l_linenumber), 0) AS VARCHAR) AS folded FROM orders LEFT JOIN ({_LINES}) ON l_orderkey = o_orderkey GROUP BY 1""")
def fold_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = number("1.00") + 0 * number("1000000000000.00")
    folded = lists.fold(lists.list_col("ITEMS", _ITEM), start, lambda acc, i: acc + i["l_quantity"] * i["l_linenumber"])
    return _nested(spark, sf_dir).select("o_orderkey", shown(folded).alias("folded"))


@query("""SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE CAST(value AS DECIMAL(18,4)) < 10) AS BIGINT) AS low FROM events GROUP BY 1""")
def event_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = ingest.exact(ingest.read(spark, f"{sf_dir}/events.parquet"), {"value": (18, 4)}, tolerance=None)
    low = num_col("value", 18, 4) < 10
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(strict(low)).alias("low"))


@query(r"""SELECT p_partkey, ltrim(chr(9) || ' ' || p_brand || ' ', ' ' || chr(9) || chr(13) || chr(10)) AS l, rtrim(' ' || p_brand || chr(13) || chr(10), ' ' || chr(9) || chr(13) || chr(10)) AS r,
  regexp_matches(p_name, '^-?[0-9]+(\.[0-9]+)?$') AS is_name, true AS is_size, CAST(p_size AS VARCHAR) = '7' AS seven FROM part""")
def trimming_and_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand, size = text_col("p_brand"), num_col(F.col("p_size").cast("decimal(10,0)"), 10, 0, "p_size")
    cols = {"l": text.ltrim(logic.concat("\t ", brand, " ")), "r": text.rtrim(logic.concat(" ", brand, "\r\n")), "is_name": numbers.isnum(text_col("p_name")), "is_size": numbers.isnum(size), "seven": logic.eql(size, 7)}
    return read(spark, sf_dir, "part").select("p_partkey", *(strict(t).alias(n) for n, t in cols.items()))


@query("""WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS v, generate_subscripts(string_split(p_name, ' '), 1) AS k FROM part)
SELECT p_partkey, coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FILTER (WHERE length(v) > 4), '') AS long_keys, coalesce(string_agg(CAST(length(v) AS VARCHAR), '+' ORDER BY k), '') AS lengths,
  CAST(sum(length(v)) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE length(v) > 4) AS BIGINT) AS n_long, bool_or(k = 2) AS has_two FROM w GROUP BY 1""")
def list_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters keep keys, maps renumber."""
    words = text.split(text_col("p_name"), " ")
    long = lists.filter_(words, lambda w, k: text.len_(w) > 4)
    lengths = lists.map_(words, lambda w, k: text.len_(w))
    cols = {"long_keys": lists.join(lists.indexes(long), ","), "lengths": lists.join(lengths, "+"), "has_two": lists.has(words, "2")}
    whole = {"total": lists.sum_(words, lambda w, k: text.len_(w)), "n_long": lists.count(long)}
    return read(spark, sf_dir, "part").select("p_partkey", *(strict(t).alias(n) for n, t in cols.items()), *(strict(t).cast("long").alias(n) for n, t in whole.items()))


@query(None)
def bitwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with their upper case: other bytes of the same number (byte lists of whole texts are too slow in DuckDB; tested
    against brute force)."""
    x = text_col("text")
    y = text.upper(x)
    docs, t = staged(read(spark, sf_dir, "documents"), {"x": bulk.bxor(x, y), "a": bulk.band(x, y), "o": bulk.bor(x, y)})
    return docs.select("doc_id", *(binary.to_hex(v).value.alias(n) for n, v in t.items()))


_BIG = "CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE '' END || CAST(o_orderkey AS VARCHAR) || '12345678901.' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')"


@query(f"""WITH t AS (SELECT o_orderkey, CAST(o_orderkey * CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END AS HUGEINT) AS k, CAST(o_custkey AS HUGEINT) AS c, {_BIG} AS big FROM orders),
u AS (SELECT *, CAST(big AS DECIMAL(38,9)) AS d FROM t)
SELECT o_orderkey, CAST(d + CAST('0.1234567' AS DECIMAL(38,9)) AS VARCHAR) AS total, CAST(k * 1000000000000 AS VARCHAR) AS product, d > 500000000000 AS large, CAST(d AS VARCHAR) AS same, d < CAST('-0.5' AS DECIMAL(38,9)) AS negative FROM u""")
def numbers_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that come as texts, with many digits: canonical texts of results are compared."""
    key = F.col("o_orderkey").cast("string")
    sign = F.when(F.col("o_orderkey") % 3 == 0, "-").otherwise("")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(sign, key, F.lit("12345678901."), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("big"), F.concat(sign, key).alias("k"), F.lit("1000000000000").alias("m"), F.lit("0.12345670000000000000").alias("part"))
    big, half = text_col("big"), number("-0.5")
    cols = {"total": exact.add(big, number("0.1234567")), "product": _text(text_col("k") * text_col("m")), "large": big > number(500000000000), "same": exact.sub(exact.add(big, text_col("part")), text_col("part")), "negative": big < half}
    done = orders.select("o_orderkey", *(strict(t).alias(n) for n, t in cols.items()))
    return done.withColumn("same", F.regexp_replace("same", r"0{11}$", ""))


@query("""WITH m AS (SELECT date_trunc('day', ts) AS start, 'type' AS rule, 'not a click' AS message FROM events WHERE event_type <> 'click'
  UNION ALL SELECT date_trunc('day', ts), 'value', 'low' FROM events WHERE CAST(value AS DECIMAL(18,4)) < 10)
SELECT strftime(start, '%Y-%m-%d') AS day, rule, message, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY 1, 2, 3""")
def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events under rules, counted in event-time windows until the input is used up."""
    import uuid

    from .streaming import monitor

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    rules = RuleSet({"value": logic.if_(num_col("value", 18, 4) < 10, "low"), "type": logic.if_(logic.text_eq(text_col("event_type"), "click"), "", "not a click")})
    counts = monitor.counted(ingest.exact(stream, {"value": (18, 4)}, None), rules, "ts", "1 day", "400 days")
    name = f"counts_{uuid.uuid4().hex}"
    counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "rule", "message", "n")
