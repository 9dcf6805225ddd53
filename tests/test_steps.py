"""The step library, decoding and contract checks as small tables."""

import random

import pytest
from pyspark.sql import functions as F

from caselake.functions import checks
from caselake.functions.checks import Expect, Schema
from caselake.functions.decode import Delimited, decode, split_values
from caselake.functions.text import relationship, shape, snake
from caselake.functions.transforms import MappingRefused, Scope, Step, Typed, apply_step, build


def run(spark, texts, kind, **options):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "i int, x string")
    built = apply_step(Step("out", kind, ("x",), options), {"x": F.col("x")})
    failed = built.failure["shape"] if built.failure is not None else F.lit(None).cast("string")
    rows = df.select("i", built.value.as_text().alias("v"), failed.alias("f")).orderBy("i").collect()
    return [r.v if r.f is None else ("failed", r.f.removeprefix("String(shape=").removesuffix(")")) for r in rows]


@pytest.mark.parametrize("kind, options, values, expected", [
    ("copy", {}, [" a ", "", " \t", None, "　"], [" a ", None, None, None, None]),
    ("trim", {}, ["\x00 a\t", "b\n", " c"], ["a", "b", " c"]),
    ("upper", {}, ["straße"], ["STRASSE"]),
    ("lower", {}, ["ABC"], ["abc"]),
    ("collapseSpace", {}, ["  a \t\n b  "], ["a b"]),
    ("digitsOnly", {}, ["a1-2", "none"], ["12", None]),
    ("nullIf", {"values": "UNK, N/A"}, ["unk", " N/A ", " x "], [None, None, " x "]),
    ("nullIf", {"values": "UNK", "ignoreCase": "false"}, ["unk", "UNK"], ["unk", None]),
    ("splitIndex", {"delimiter": ",", "index": "1"}, ["A, B", "A", "A,", "A,,C"], ["B", None, None, None]),
    ("splitIndex", {"delimiter": ".", "index": "0", "trim": "false"}, [" a .b"], [" a "]),
    ("regexExtract", {"pattern": r"(\d+)-(\d+)", "group": "2"}, ["x 12-34 5-6", "none"], ["34", None]),
    ("regexReplace", {"pattern": "[^0-9]"}, ["a1b2", "ab"], ["12", None]),
    ("regexReplace", {"pattern": "(a)(b)", "replacement": "$2$1"}, ["xabx"], ["xbax"]),
    ("parseDate", {"pattern": "MM/dd/yyyy"}, [" 02/28/2023 ", "02/30/2023", "02/30/2024", "13/01/2023", "1/1/2023", "2023-01-01"],
     ["2023-02-28", "2023-02-28", "2024-02-29", ("failed", "##/##/####"), ("failed", "#/#/####"), ("failed", "####-##-##")]),
    ("parseDate", {"pattern": "yyyyMMdd"}, ["20240131", "2024013"], ["2024-01-31", ("failed", "#######")]),
    ("parseDate", {"pattern": "d/M/yyyy"}, ["1/2/2024", "01/02/2024"], ["2024-02-01", "2024-02-01"]),
    ("parseDateTime", {"pattern": "yyyy-MM-dd'T'HH:mm", "zone": "America/Denver"},
     ["2026-03-08T02:30", "2026-11-01T01:30", "2026-07-01T24:00", "2026-07-01T24:01"],
     ["2026-03-08T09:30:00Z", "2026-11-01T07:30:00Z", "2026-07-02T06:00:00Z", ("failed", "####-##-##A##:##")]),
    ("parseInteger", {}, [" 42 ", "+7", "-0", "4.0", "99999999999999999999", ""], ["42", "7", "0", ("failed", "#.#"), ("failed", "#" * 20), None]),
    ("parseDecimal", {}, ["1.50", ".5", "5.", "-1e3", "1.1234567891", "1.1234567890", "1e-10", "x"],
     ["1.5", "0.5", "5", "-1000", ("failed", "#.##########"), "1.123456789", ("failed", "#A-##"), ("failed", "A")]),
    ("codeMap", {"map": "a=1, B=2"}, [" A ", "b", "c", None], ["1", "2", ("failed", "A"), None]),
    ("codeMap", {"map": "a=1", "ignoreCase": "false", "default": "0"}, ["A", "a", " "], ["0", "1", None]),
])
def test_step(spark, kind, options, values, expected):
    assert run(spark, values, kind, **options) == expected


def test_literal_concat_and_coalesce(spark):
    df = spark.createDataFrame([("a", " ", "c"), (None, None, None)], "x string, y string, z string")
    src = {c: F.col(c) for c in "xyz"}
    make = lambda kind, **o: apply_step(Step("t", kind, ("x", "y", "z"), o), src).value.col
    rows = df.select(make("concat", separator="-").alias("loose"), make("concat", skipMissing="false").alias("strict"),
                     make("coalesce").alias("first"), apply_step(Step("t", "literal", (), {"value": "k"}), src).value.col.alias("k")).collect()
    assert [tuple(r) for r in rows] == [("a-c", None, "a", "k"), (None, None, None, "k")]


def test_a_step_reads_what_an_earlier_one_wrote(spark):
    df = spark.createDataFrame([("src", "  ")], "a string, b string")
    scope = Scope({"a": F.col("a"), "b": F.col("b")}, {"a": Typed(F.lit(None).cast("string")), "b": Typed(F.lit("new"))})
    copy = lambda n: build(Step("t", "copy", (n,)), scope).value.col
    first = build(Step("t", "coalesce", ("a", "b")), scope).value.col
    # A null output falls back to the source for text, but coalesce takes the written value even when null.
    assert tuple(df.select(copy("a"), copy("b"), first).first()) == ("src", "new", "new")


@pytest.mark.parametrize("step", [
    Step("t", "reverse", ("x",)), Step("t", "copy", ("x",), {"pattern": "x"}), Step("t", "parseDate", ("x",)),
    Step("t", "copy", ("x", "y")), Step("t", "coalesce", ("x",)), Step("t", "codeMap", ("x",), {"map": "novalue"}),
    Step("t", "splitIndex", ("x",), {"delimiter": ",", "index": "-1"})])
def test_specification_errors_are_refused_up_front(spark, step):
    with pytest.raises(MappingRefused):
        apply_step(step, {"x": F.col("x"), "y": F.col("y")})


def plain_split(line, delimiter=",", quote='"'):
    values, current, inside, i = [], "", False, 0
    while i < len(line):
        c = line[i]
        if inside and c == quote and line[i + 1:i + 2] == quote:
            current, i = current + quote, i + 1
        elif c == quote:
            inside = not inside
        elif c == delimiter and not inside:
            values.append(current)
            current = ""
        else:
            current += c
        i += 1
    return values + [current]


@pytest.mark.parametrize("delimiter, quote", [(",", '"'), ("|", "'"), ("^", "-")])
def test_decoding_agrees_with_a_plain_state_machine(spark, delimiter, quote):
    rng = random.Random(7)
    alphabet = ["a", "é", " ", delimiter, delimiter, quote, quote, "\\", "$"]
    lines = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    lines += ["", quote, quote * 2, quote * 3, "x" * 40000 + quote + delimiter + "y" * 40000]
    df = spark.createDataFrame([(l,) for l in lines], "line string").coalesce(4)
    for r in df.select("line", split_values(F.col("line"), delimiter, quote).alias("v")).collect():
        assert r.v == plain_split(r.line, delimiter, quote), r.line[:80]


def test_declared_extra_and_absent_columns(spark):
    df = spark.createDataFrame([(b" a ,,\"x\",, e ",), (b"a",), (b"\xff,b",)], "payload binary")
    rows = decode(df, Delimited(("A", "B", "C"))).collect()
    assert (rows[0].A, rows[0].B, rows[0].C, rows[0].extra) == ("a", None, "x", {"column4": "", "column5": " e "})
    assert (rows[1].A, rows[1].B, rows[1].n_values, rows[1].extra) == ("a", None, 1, None)
    assert rows[2].A == "�"


def test_checks_report_everything_and_agree_with_passes(spark):
    schema = Schema("s", (Expect("code", "code", codes=("A",)), Expect("need", required=True), Expect("p", pattern=r"\d+$"),
                          Expect("when", "date"), Expect("tags", repeated=True, pattern="[a-z]+"), Expect("to", "ref", ref_type="Person")))
    rows = spark.createDataFrame([
        (1, "A", "", "12", None, ["ab", None], ("Person", "1"), None),
        (2, "B", None, "1\n", "2020-01-01", ["ab", "C", "D"], ("Place", "1"), {"column7": "x1"}),
        (3, None, "x", None, None, None, None, None)],
        "id int, code string, need string, p string, when string, tags array<string>, to struct<typeName:string,id:string>, extra map<string,string>")
    cols = {c: (F.col(c), rows.schema[c].dataType) for c in ("code", "need", "p", "when", "tags", "to")}
    out = rows.select("id", checks.failures(schema, cols, F.col("extra")).alias("f"), checks.passes(schema, cols, F.col("extra")).alias("ok"),
                      checks.failures(schema.tolerate(), cols, F.col("extra")).alias("t")).orderBy("id").collect()
    assert [(r.ok, [(f.field, f.rule) for f in r.f]) for r in out] == [
        (True, []),
        (False, [("code", "codeList"), ("need", "required"), ("p", "pattern"), ("when", "type"), ("to", "refType"),
                 ("tags[]", "pattern"), ("tags[]", "pattern"), ("column7", "unexpectedField")]),
        (True, [])]
    assert len(out[1].t) == 7
    assert out[1].f[0].shape == "String(len=1, shape=A)" and out[1].f[1].shape == "absent"
    with pytest.raises(ValueError):
        Schema("twice", (Expect("a"), Expect("a")))


def test_shapes_and_names(spark):
    df = spark.createDataFrame([("K447-19 é",), ("x" * 40,), ("",)], "v string")
    assert [r[0] for r in df.select(shape(F.col("v"))).collect()] == ["A###-##_A", "A" * 32 + "…", ""]
    assert snake("driverLicenseId") == "driver_license_id" and snake("FBINumber") == "fbi_number"
    assert relationship("PersonIncidentAssociation") == "PERSON_INCIDENT_ASSOCIATION"
