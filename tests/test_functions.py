"""Each case runs on literals and on columns of a DataFrame; literals alone would be folded before Spark computes anything."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ruleloom.functions import binary as b
from ruleloom.functions import exact as ex
from ruleloom.functions import logic as lg
from ruleloom.functions import numbers as n
from ruleloom.functions import regex as r
from ruleloom.functions import text as t
from ruleloom.functions.terms import as_text, bin_col, captured, num_col, number, strict, term, text_col
from ruleloom.operators import lists
from ruleloom.plans.ruleset import RuleSet, dump

WORD, POLISH, THUMB = "Zażółć", "Ä1ż", "👍a"

# (builder of one argument, text argument, expected canonical text or error)
TEXT_CASES = [
    (t.len_, WORD, "6"), (t.len_, THUMB, "2"), (t.len_, "", "0"),
    (lambda x: t.left(x, 2), WORD, "Za"), (lambda x: t.left(x, -1), WORD, "E_RANGE"), (lambda x: t.left(x, number("1.5")), WORD, "E_NOT_INT"), (lambda x: t.left(x, 99), WORD, WORD),
    (lambda x: t.right(x, 2), WORD, "łć"), (lambda x: t.right(x, 0), WORD, ""),
    (lambda x: t.substr(x, 2, 3), WORD, "ażó"), (lambda x: t.substr(x, 0, 3), WORD, "E_RANGE"), (lambda x: t.substr(x, 9), WORD, ""), (lambda x: t.substr(x, 2, number("99999999999999999999")), WORD, WORD[1:]),
    (lambda x: t.find("ż", x), WORD, "3"), (lambda x: t.find("a", x), THUMB, "2"), (lambda x: t.find("q", x), WORD, "0"), (lambda x: t.find("", x), WORD, "E_BAD_ARG"), (lambda x: t.find("a", x, 0), WORD, "E_RANGE"),
    (lambda x: t.replace("a", "bb", x), "banana", "bbbnbbnbb"), (lambda x: t.replace("", "b", x), "a", "E_BAD_ARG"), (lambda x: t.replace("aa", "b", x), "aaa", "ba"),
    (t.trim, " \t\r\n x y\n", "x y"), (t.ltrim, "\t x ", "x "), (t.rtrim, " x\r\n", " x"), (t.trim, " x", " x"),
    (t.upper, "straße ä", "STRAßE ä"), (t.lower, "ÄBC", "Äbc"), (t.backwards, THUMB, "a👍"),
    (lambda x: t.repeat(x, 3), "ab", "ababab"), (lambda x: t.repeat(x, -1), "ab", "E_RANGE"), (lambda x: t.repeat(x, 10**9), "ab", "E_RANGE"),
    (lambda x: t.padl(x, 6, "12"), "ab", "1212ab"), (lambda x: t.padr(x, 5, "12"), "ab", "ab121"), (lambda x: t.padl(x, 1, "0"), "abcd", "abcd"), (lambda x: t.padl(x, 9, ""), "ab", "E_BAD_ARG"),
    (t.code, THUMB, "128077"), (t.code, "", "E_RANGE"), (t.char, "128077", "👍"), (t.char, "55296", "E_RANGE"), (t.char, "1114112", "E_RANGE"),
    (lambda x: lists.join(t.split(x, "."), "|"), "a.b..", "a|b||"), (lambda x: lists.count(t.split(x, "\\E")), "a\\Eb", "2"), (lambda x: lists.count(t.split(x, ",")), "", "1"),
    (lambda x: lg.concat(x, "-", 5), POLISH, POLISH + "-5"), (lambda x: lg.concat(x, term(True)), "a", "E_NOT_TEXT"),
    # numbers in texts
    (lambda x: x + 1, "2.50", "3.50"), (lambda x: x + 1, "abc", "E_NOT_NUM"), (lambda x: x + 1, " 2", "E_NOT_NUM"), (lambda x: x + 1, "٣", "E_NOT_NUM"), (lambda x: x * x, "1.5", "2.25"),
    (lambda x: x + 1, "1.1234567", "2.1234567"), (lambda x: x * x, "1.1234567", "1.26215495677489"), (lambda x: x * "3", "1000000000000", "3000000000000"), (lambda x: x * "-3", "0.5", "-1.5"), (lambda x: x * "0.05", "-0.1", "-0.005"), (lambda x: x + 1, "1." + "1" * 37, "E_RANGE"),
    (lambda x: x > 1, "1.12345678901234567890", "TRUE"), (lambda x: x == "1.1", "01.1000000000000000000000", "TRUE"), (lambda x: x < "-1.00000000000000000000001", "-1.00000000000000000000002", "TRUE"), (lambda x: x == "0", "-0.000", "TRUE"), (lambda x: x < 10, "9" * 60, "FALSE"), (lambda x: x > "a", "1", "E_NOT_NUM"), (lambda x: x >= "-5", "-05.0", "TRUE"), (lambda x: x != number("2.50"), "2.5", "FALSE"), (lambda x: x < "1", "-7", "TRUE"), (lambda x: x / 4, "12345678901234567.5", "3086419725308641.875"), (lambda x: x / "0.000001", "1.5", "1500000"),
    # numbers of any length
    (lambda x: ex.mul(x, "987654321"), "123456789012345678901234567890", "121932631124828532112482853211126352690"), (lambda x: ex.add(x, 1), "1.12345678901234567890", "2.12345678901234567890"), (lambda x: ex.sub(x, "0.50"), "0.5", "0.00"), (lambda x: ex.div(x, 3), "-2", "-0.6666666667"), (lambda x: ex.div(x, 4), "10", "2.5"), (lambda x: ex.div(x, "0.0"), "1", "E_DIV_ZERO"), (lambda x: ex.mod(x, 3), "-5.5", "-2.5"), (lambda x: ex.power(x, 40), "10", "1" + "0" * 40), (lambda x: ex.power(x, "-1"), "10", "E_RANGE"), (lambda x: ex.round_(x, "40"), "2.5", "2.5" + "0" * 39), (lambda x: ex.round_(x, 0), "-2.5", "-3"), (lambda x: ex.round_(x, "0.5"), "1", "E_NOT_INT"), (lambda x: ex.add(x, 1), "abc", "E_NOT_NUM"), (lambda x: ex.add(x, x), "-0.0", "0.0"),
    (lambda x: x - number("0.5"), "0.50", "0.00"), (lambda x: -x, "0.00", "0.00"), (lambda x: x % 3, "-5", "-2"), (lambda x: x % 2, "5.5", "1.5"), (lambda x: x % 0, "5", "E_DIV_ZERO"),
    (lambda x: x / 2, "4", "2"), (lambda x: x / 4, "10", "2.5"), (lambda x: x / 8, "1", "0.125"), (lambda x: x / 3, "1", "0.3333333333"), (lambda x: x / 3, "2", "0.6666666667"), (lambda x: x / 3, "-2", "-0.6666666667"), (lambda x: x / 0, "1", "E_DIV_ZERO"), (lambda x: x / number("0.50"), "2.50", "5"),
    (lambda x: n.round_(x, 0), "2.5", "3"), (lambda x: n.round_(x, 0), "-2.5", "-3"), (lambda x: n.round_(x, 3), "2", "2.000"), (lambda x: n.round_(x, -1), "2", "E_RANGE"),
    (n.abs_, "-2.50", "2.50"), (n.sign, "-2.50", "-1"), (n.ceil, "-2.5", "-2"), (n.floor, "-2.5", "-3"), (n.trunc, "-2.9", "-2"),
    (lambda x: n.power(x, 3), "1.5", "3.375"), (lambda x: n.power(x, 0), "7", "1"), (lambda x: n.power(x, -1), "7", "E_RANGE"),
    (lambda x: n.min_(x, "2"), "2.0", "2.0"), (lambda x: n.max_(x, "3", "2.50"), "2", "3"), (lambda x: n.min_(x), "2.0", "2.0"),
    (n.isnum, "007", "TRUE"), (n.isnum, "1.", "FALSE"), (n.isnum, "1\n", "FALSE"), (n.isnum, "-1.5", "TRUE"),
    (lambda x: x == 5, "5.00", "TRUE"), (lambda x: lg.text_eq(x, 5), "5.00", "FALSE"), (lambda x: lg.eql(x, "5"), "5.00", "FALSE"), (lambda x: lg.in_(x, "a", "b"), "b", "TRUE"), (lambda x: lg.in_(x, number("2.0")), "2", "FALSE"),
    (lambda x: lg.text_lt(x, "\U0001f44d"), "�", "TRUE"),
    # bytes
    (b.blen, WORD, "10"), (lambda x: b.to_hex(x), "ż", "c5bc"), (lambda x: b.from_utf8(b.from_hex(x)), "C5bc", "ż"), (lambda x: b.from_utf8(b.from_hex(x)), "c080", "E_UTF8"), (lambda x: b.from_utf8(b.from_hex(x)), "eda080", "E_UTF8"), (b.from_hex, "abc", "E_BAD_ARG"), (b.from_hex, "zz", "E_BAD_ARG"),
    (lambda x: b.encode_base64(x), "abcd", "YWJjZA=="), (lambda x: b.from_utf8(b.decode_base64(x)), "YWJjZA==", "abcd"), (b.decode_base64, "YWJjZA", "E_BAD_ARG"), (lambda x: t.len_(b.encode_base64(t.repeat(x, 100))), "a", "136"),
    (b.crc32, "123456789", "cbf43926"), (b.crc32, "", "00000000"), (lambda x: lists.join(b.btl(x), ","), "AB", "65,66"), (lambda x: b.from_utf8(b.ltb(b.btl(x))), "AB", "AB"), (lambda x: b.ltb(b.btl(x)), "", "E_NO_SCALAR"),
    (lambda x: b.to_hex(lg.bxor(x, "ab")), "AB", "2020"), (lambda x: b.to_hex(lg.band(x, "ab")), "AB", "4142"), (lambda x: b.to_hex(lg.bor(x, "ab")), "AB", "6162"), (lambda x: lg.bxor(x, "a"), "AB", "E_LEN_MISMATCH"),
    # regular expressions
    (lambda x: r.rmatch("^abc$", x), "abc\n", "FALSE"), (lambda x: r.rmatch("a.c", x), "a\nc", "TRUE"), (lambda x: r.rmatch(r"^\d$", x), "١", "FALSE"), (lambda x: r.rmatch(r"^\w+$", x), "aż", "FALSE"), (lambda x: r.rmatch("[a[b]", x), "[", "TRUE"), (lambda x: r.rmatch("[a&&b]", x), "&", "TRUE"),
    (lambda x: r.rmatch("k", x, "i"), "K", "TRUE"), (lambda x: r.rmatch("s", x, "i"), "ſ", "TRUE"), (lambda x: r.rmatch("i", x, "i"), "İ", "FALSE"), (lambda x: r.rmatch("[a-z]", x, "i"), "K", "TRUE"), (lambda x: r.rmatch("ż", x, "i"), "ż", "E_BAD_ARG"),
    (lambda x: r.rfind("a", x), "👍ża", "3"), (lambda x: r.rfind("q", x), "abc", "0"), (lambda x: r.rfind("^a|c", x), "bc", "2"), (lambda x: r.rfind("^", x), "aab", "1"), (lambda x: r.rfind("[^a]*", x), "aab", "1"), (lambda x: r.rfind("$", x), "👍b", "3"), (lambda x: r.rfind("^b", x), "ab", "0"), (lambda x: r.rfind("^", x), "", "1"), (lambda x: r.rfind("[^👍]", x), "👍👍ż", "3"), (lambda x: r.rfind("", x), "a", "1"),
    (lambda x: lists.join(r.rgroups("(a)|(b)", x), ","), "b", "b,,b"), (lambda x: lists.count(r.rgroups("q", x)), "b", "0"),
    (lambda x: r.rreplace("x*", "-", x), "ab", "-a-b-"), (lambda x: r.rreplace("(a)(b)", "$2$1$$\\", x), "abab", "ba$\\ba$\\"), (lambda x: r.rreplace("a", "$1", x), "a", "E_BAD_ARG"), (lambda x: r.rreplace("a", "$1", x), "b", "b"), (lambda x: r.rreplace("(a)", "$10", x), "a", "a0"), (lambda x: r.rreplace("^a", "X", x), "aaa", "Xaa"),
    # laziness
    (lambda x: lg.if_(x == 1, "yes", x / 0), "1", "yes"), (lambda x: lg.if_(x == 1, x / 0, "no"), "1", "E_DIV_ZERO"), (lambda x: lg.and_(x == 2, x / 0 == 1), "1", "FALSE"), (lambda x: lg.or_(x == 1, x / 0 == 1), "1", "TRUE"), (lambda x: lg.if_(x, "a", "b"), "x", "E_NOT_BOOL"),
    (lambda x: lg.cond(x == 1, "one", x == 2, "two", "more"), "2", "two"), (lambda x: lg.cond(x == 1, "one", x / 0 == 1, "two", "more"), "1", "one"), (lambda x: lg.abort(x), "stop", "E_ABORT: stop"), (lambda x: lg.if_(lg.text_eq(x, "b"), "c"), "a", ""),
    (lambda x: lg.xor(x == 1, x == 1), "1", "FALSE"), (lambda x: ~(x == 1), "1", "FALSE"), (lambda x: lg.if_(x == 1, number("2.50"), 3), "1", "2.50"), (lambda x: lg.if_(x == 1, number("2.50"), 3), "2", "3"),
    # first error in order
    (lambda x: (x / 0) + "abc", "1", "E_DIV_ZERO"), (lambda x: lg.concat(x / 0, t.left(x, -1)), "1", "E_DIV_ZERO"),
]


def _canonical(x):
    x = term(x)
    if x.kind == "bool":
        return F.coalesce(x.error, F.when(x.value, "TRUE").otherwise("FALSE")) if x.error is not None else F.when(x.value, "TRUE").otherwise("FALSE")
    if x.kind in ("bin", "list"):
        return F.coalesce(x.error, F.lit(x.kind)) if x.error is not None else F.lit(x.kind)
    s = as_text(x)
    return F.coalesce(s.error, s.value) if s.error is not None else s.value


@pytest.mark.parametrize("literal", [False, True])
def test_text_cases(spark, literal):
    rows = spark.createDataFrame([tuple(v for _, v, _ in TEXT_CASES)], [f"c{i}" for i in range(len(TEXT_CASES))])
    wrong = []
    for at in range(0, len(TEXT_CASES), 40):
        part = list(enumerate(TEXT_CASES))[at : at + 40]
        got = rows.select(*(_canonical(f(term(v) if literal else text_col(f"c{i}"))).alias(f"r{i}") for i, (f, v, _) in part)).first()
        wrong += [(i, v, got[f"r{i}"], want) for i, (_, v, want) in part if got[f"r{i}"] != want]
    assert not wrong


@pytest.mark.parametrize("pattern", [r"\bx", "(?=a)", "(?i)a", r"\p{L}", "[[:alpha:]]", "a{3,2}", "a{65536}", "*a", "a**", "(a", "a)", r"(a)\1", r"\A", "[]a]", r"[\D]", "a++", r"\v", "a{1", "["])
def test_patterns_outside_the_subset(pattern):
    with pytest.raises(r.Syntax):
        r.portable(pattern)


@pytest.mark.parametrize("pattern", ["a{2,65535}?", r"(?:a|b)+", r"[^\d.]", r"\.\\\[", "a|", "", "^$", "[a-z-]", "x{3}"])
def test_patterns_inside_the_subset(spark, pattern):
    spark.range(1).select(F.lit("aż").rlike(r.portable(pattern)[0])).first()


def test_lists(spark):
    df = spark.createDataFrame([([1, 2, 3], [("AB-1234", "3", "19.99"), ("CD", "0", "5.00")]), ([], []), (None, None)], "n array<int>, items array<struct<SKU:string,QTY:string,PRICE:string>>")
    num = lambda c: num_col(c.cast("decimal(10,0)"), 10, 0)
    xs = lists.list_col("n", num)
    items = lists.list_col("items", lists.records({k: (lambda c: text_col(c)) for k in ("SKU", "QTY", "PRICE")}))
    cols = {
        "sum": lists.sum_(xs), "all": lists.all_(xs, lambda x, k: x > 0), "any": lists.any_(xs, lambda x, k: x > 2), "stop": lists.any_(xs, lambda x, k: lg.if_(x == 1, term(True), x / 0 == 1)),
        "map": lists.join(lists.map_(xs, lambda x, k: x * 2), ","), "keys": lists.join(lists.indexes(lists.filter_(xs, lambda x, k: x != 2)), ","), "count": lists.count(lists.filter_(xs, lambda x, k: x > 1)),
        "first": xs[1], "gone": lists.filter_(xs, lambda x, k: x != 2)["2"], "has": lists.has(xs, "01"), "total": lists.sum_(items, lambda i, k: i["QTY"] * i["PRICE"]), "sku": items[1]["SKU"],
        "bad": lists.join(lists.map_(lists.filter_(items, lambda i, k: ~r.rmatch(r"^[A-Z]{2}-\d{4}$", i["SKU"])), lambda i, k: i["SKU"]), ", "), "err": lists.sum_(xs, lambda x, k: 1 / (x - 2)), "nokey": items[1]["NOPE"], "fold": lists.fold(xs, number("000000001") * 1 + 0 * number(10**6), lambda acc, x: acc * x),
        "in": lg.in_(term(2), xs), "kk": lists.join(lists.map_(xs, lambda x, k: lg.concat(k, ":", x)), " "),
    }
    got = [x.asDict() for x in df.select(*(_canonical(v).alias(k) for k, v in cols.items())).collect()]
    empty = {"sum": "0", "all": "TRUE", "any": "FALSE", "stop": "FALSE", "map": "", "keys": "", "count": "0", "first": "E_NO_KEY", "gone": "E_NO_KEY", "has": "FALSE", "total": "0", "sku": "E_NO_KEY", "bad": "", "err": "0", "nokey": "E_NO_KEY", "fold": "1", "in": "FALSE", "kk": ""}
    assert got[0] == {"sum": "6", "all": "TRUE", "any": "TRUE", "stop": "TRUE", "map": "2,4,6", "keys": "1,3", "count": "2", "first": "1", "gone": "E_NO_KEY", "has": "FALSE", "total": "59.97", "sku": "AB-1234", "bad": "CD", "err": "E_DIV_ZERO", "nokey": "E_NO_KEY", "fold": "6", "in": "TRUE", "kk": "1:1 2:2 3:3"}
    assert got[1] == empty and got[2] == empty


def test_scale_of_sums_follows_the_rows(spark):
    df = spark.createDataFrame([(["1.5", "2.25"],), (["1", "2"],)], "xs array<string>")
    assert [x[0] for x in df.select(_canonical(lists.sum_(lists.list_col("xs", text_col)))).collect()] == ["3.75", "3"]


def test_strict_fails_and_capture_does_not(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "a string")
    bad = text_col("a") + 1
    assert [x[0]["error"] for x in df.select(captured(bad)).collect()] == [None, "E_NOT_NUM", "E_NOT_TEXT"]
    with pytest.raises(Exception, match="E_NOT_NUM"):
        df.where("a = 'x'").select(strict(bad)).collect()


def test_floats_are_refused():
    with pytest.raises(TypeError):
        term(0.5)
    with pytest.raises(TypeError):
        bool(term(1) == 1)


def test_rule_set(spark):
    df = spark.createDataFrame([("a", Decimal("1.00")), ("", Decimal("-2.50"))], "name string, bal decimal(15,2)")
    rules = RuleSet({"name": lg.if_(t.is_blank(text_col("name")), "required", ""), "bal": lg.if_(num_col("bal", 15, 2) < 0, lg.concat("negative: ", num_col("bal", 15, 2)), "")})
    assert rules.watch() == {"name": ["name"], "bal": ["bal"]}
    assert rules.dependencies("bal") == {"bal"}
    assert [tuple(x) for x in rules.apply(df, keep=[]).collect()] == [("", ""), ("required", "negative: -2.50")]
    assert {(x.rule, x.message) for x in rules.messages(df, ["name"]).collect()} == {("name", "required"), ("bal", "negative: -2.50")}
    assert rules.rerun(df, ["bal"], ["name"]).columns == ["name", "bal"]
    assert {(x.rule, x.n) for x in rules.summary(df).collect()} == {("name", 1), ("bal", 1)}
    assert df.select(dump(lists.array_of(1, number("2.50")))).first()[0] == '-{"1"=t"1","2"=t"2.50"}'


def test_rules_read_results_before_them(spark):
    df = spark.createDataFrame([("4", "2"), ("4", "0"), ("x", "1")], "a string, b string")
    a, b_ = text_col("a"), text_col("b")
    rules = RuleSet({"half": a / b_, "label": lambda r: lg.concat("is ", r["half"]), "seen": lambda r: lg.if_(lg.text_eq(b_, "0"), "none", r["label"])})
    got = [(r.half.value, r.half.error, r.label.value, r.label.error, r.seen.value, r.seen.error) for r in rules.apply(df, "capture", []).collect()]
    assert got == [("2", None, "is 2", None, "is 2", None), (None, "E_DIV_ZERO", None, "E_DIV_ZERO", "none", None), (None, "E_NOT_NUM", None, "E_NOT_NUM", None, "E_NOT_NUM")]
    assert rules.dependencies("label") == {"a", "b"} and rules.watch()["a"] == ["half", "label", "seen"]
    with pytest.raises(KeyError):
        RuleSet({"one": lambda r: r["two"], "two": 1})


def test_registered_functions(spark):
    from ruleloom.functions.registry import call, register_function, unregister_function

    register_function("twice", 1, lambda x: lg.concat(x, x))
    register_function("first_good", (1, None), lambda x, *more: lg.if_(t.is_blank(x), more[0] if more else "", x), lazy=True)
    register_function("ratio", 2, lambda x, y: x / y)
    try:
        df = spark.createDataFrame([("4", "2"), ("4", "0"), ("", "1"), (None, "1")], "a string, b string")
        a, b_ = text_col("a"), text_col("b")
        cols = {"twice": call("TWICE", a), "good": call("first_good", a, 1 / (term(1) - 1)), "ratio": as_text(call("ratio", a, b_)), "deep": call("twice", call("ratio", a, b_))}
        got = [tuple(r[n].error or r[n].value for n in cols) for r in df.select(*(captured(x).alias(n) for n, x in cols.items())).collect()]
        assert got == [("44", "4", "2", "22"), ("44", "4", "E_DIV_ZERO", "E_DIV_ZERO"), ("", "E_DIV_ZERO", "E_NOT_NUM", "E_NOT_NUM"), ("E_NOT_TEXT",) * 4]
        assert cols["deep"].deps == {"a", "b"}
        with pytest.raises(TypeError, match="E_ARITY"):
            call("ratio", a)
        with pytest.raises(LookupError, match="E_UNKNOWN_FUNC"):
            call("nothing", a)
        for name, arity in (("twice", 1), ("2x", 1), ("x", (2, 1))):
            with pytest.raises(ValueError):
                register_function(name, arity, term)
    finally:
        for name in ("twice", "first_good", "ratio"):
            unregister_function(name)


def test_bytes_of_whole_texts(spark):
    """Arrow batches equal expressions, also around the words that expressions combine; a byte list is read once for value and error."""
    import operator

    from ruleloom.functions import bulk
    from ruleloom.functions.terms import staged

    rows = [(i, bytes((i * 37 + j * j) % 256 for j in range(i)), bytes((i + 91 * j) % 256 for j in range(i))) for i in (*range(30), 1000)] + [(40, b"ab", b"a"), (41, None, b"a"), (42, b"a", None), (43, b"\xff" * 7, b"\x00" * 7)]
    df = spark.createDataFrame(rows, "i int, a binary, b binary").repartition(2)
    x, y = bin_col("a"), bin_col("b")
    for name, op in (("band", operator.and_), ("bor", operator.or_), ("bxor", operator.xor)):
        got = {r.i: r for r in df.select("i", *(captured(getattr(m, name)(x, y)).alias(m.__name__[-5:]) for m in (lg, bulk))).collect()}
        for i, a, c in rows:
            want = (None, "E_NOT_BIN") if a is None or c is None else (None, "E_LEN_MISMATCH") if len(a) != len(c) else (bytes(map(op, a, c)), None)
            assert tuple(got[i]["logic"]) == want and tuple(got[i][".bulk"]) == want, (name, i)

    done, terms = staged(df, {"list": b.ltb(b.btl(x))})
    assert [c for c in done.columns if c.startswith("__")] == ["__list"]
    want = {i: (a or None, "E_NOT_BIN" if a is None else None if a else "E_NO_SCALAR") for i, a, _ in rows}
    assert {r.i: tuple(r["c"]) for r in done.select("i", captured(terms["list"]).alias("c")).collect()} == want
    for items, want in ((["1", "255"], b"\x01\xff"), (["256"], "E_RANGE"), (["-1"], "E_RANGE"), (["1.0"], "E_RANGE"), (["1.5"], "E_RANGE"), (["x", "300"], "E_NOT_NUM"), ([None], "E_NOT_NUM"), (["0", "99999999999"], "E_RANGE")):
        one = spark.createDataFrame([(items,)], "xs array<string>").select(captured(b.ltb(lists.list_col("xs", text_col))).alias("c")).first()["c"]
        assert (one["error"] or bytes(one["value"])) == want, items


def test_forms_of_encodings(spark):
    cases = {"": (b"", b""), "abcd": (b"\xab\xcd", b"\x69\xb7\x1d"), "ab": (b"\xab", None), "YQ==": (None, b"a"), "YWI=": (None, b"ab"), "Y===": (None, None), "=": (None, None), "YQ==YQ==": (None, None), "abcd\n": (None, None), "żż": (None, None), "zz": (None, None), "ab c": (None, None)}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = df.select("s", captured(b.from_hex(text_col("s"))).alias("h"), captured(b.decode_base64(text_col("s"))).alias("d")).collect()
    for r in got:
        for c, want in zip((r.h, r.d), cases[r.s], strict=True):
            assert (c["value"], c["error"]) == ((None, "E_BAD_ARG") if want is None else (want, None)), r.s


def test_results_that_others_read_are_computed_once(spark):
    """Each rule mentions the one before it three times: as one expression, three of them mention the first 27 times."""
    df = spark.createDataFrame([("3", "2"), ("3", "0"), ("x", "1")], "a string, b string")
    rules = {"r0": text_col("a") / text_col("b")}
    for i in range(1, 4):
        rules[f"r{i}"] = lambda r, last=f"r{i - 1}": r[last] + r[last] - r[last]
    made = RuleSet(rules).apply(df, "capture", ["a"])
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("nullif") + plan.count("E_DIV_ZERO") < 20
    got = made.collect()
    assert made.columns == ["a", *rules]
    assert [tuple(r["r3"]) for r in got] == [("1.5", None), (None, "E_DIV_ZERO"), (None, "E_NOT_NUM")]
    want = RuleSet(rules).messages(df, ["a", "b"]).collect()
    assert {(r.a, r.b, r.message, r.error) for r in want if r.rule == "r3"} == {("3", "2", "1.5", None), ("3", "0", None, "E_DIV_ZERO"), ("x", "1", None, "E_NOT_NUM")}


def test_nested_gathers_each_field_once(spark):
    from ruleloom.sources import ingest

    kids = spark.createDataFrame([(1, 2, "b", 5), (1, None, "z", 7), (1, 1, "c", None), (1, 1, "a", 6), (3, 1, "q", 0)], "k long, o int, s string, v int")
    made = ingest.nested(spark.createDataFrame([(1,), (2,)], "k long"), kids, "k", "XS", ["v", "s"], ["o", "s"])
    assert "array_sort(" not in made._jdf.queryExecution().optimizedPlan().toString() and made.schema["XS"].dataType.elementType.names == ["v", "s"]
    assert {r.k: [tuple(x) for x in r.XS] for r in made.collect()} == {1: [(7, "z"), (6, "a"), (None, "c"), (5, "b")], 2: []}
