from decimal import Decimal
from fnmatch import fnmatchcase

import pytest
from pyspark.sql import functions as F

from rowloom.functions import ids, inputs, text, validate, values
from rowloom.functions.clean import strip_buffers
from rowloom.schemas import FIELDS, TYPE_OF_TAG


def fields(mapping):
    parts = [p for k, v in mapping.items() for p in (F.lit(k), F.lit(v).cast("string"))]
    return F.create_map(*parts).cast(FIELDS)


@pytest.mark.parametrize(
    "job_id, uuid",
    [("h/u/job.abc", "abc"), ("job.abc", "abc"), ("abc", "abc"), ("xjob.1/job.2.job.3", "2.job.3"), ("", ""),
     ("a/job.b/job.c", "c"), ("xjob.1.job.2", "2")],
)
def test_job_uuid(one, job_id, uuid):
    assert one(ids.job_uuid(F.lit(job_id))) == uuid


@pytest.mark.parametrize(
    "path, expected",
    [("h/u/x", ("h", "u", True)), ("h/u", ("h", "u", True)), ("h", (None, None, False)), ("", (None, None, False)),
     ("/u", ("", "u", True))],
)
def test_split_path(one, path, expected):
    assert tuple(one(ids.split_path(F.lit(path)))) == expected


def test_item_ids_distinguish_absent_from_null(one):
    assert one(ids.document_item_id(fields({"pk": "p", "object_id": "o"}))) == "p"
    assert one(ids.document_item_id(fields({"object_id": "o"}))) == "o"
    assert one(ids.document_item_id(fields({"pk": None, "object_id": "o"}))) is None
    assert one(ids.document_item_id(fields({"x": "1"}))) == "unknown"
    assert one(ids.stream_item_id(F.lit("s"), F.lit(None).cast("bigint"))) == "s@unknown"


def test_receipt_stream_shows_null_host(one):
    assert one(ids.receipt_stream_id(F.lit(None).cast("string"), F.lit("u"), F.lit("h/u/job.7"))) == "None/u/stream-run-all.7"


def test_key_presence_wins_over_value(one):
    bound = one(inputs.bind_inputs(
        fields({"a": "const", "b": "const", "c": "const"}), fields({"a": None, "b": ""}), {"object_id": F.lit("i")}
    ))
    assert bound == {"a": None, "b": "", "c": "const", "object_id": "i"}


def test_bind_without_constants_or_item(one):
    nothing = F.lit(None).cast(FIELDS)
    assert one(inputs.bind_inputs(nothing, nothing, {"key": F.lit("k")})) == {"key": "k"}


def test_inject_context(one):
    both = F.array(F.lit("hostname"), F.lit("username"))
    call = lambda m, params, host, user: one(inputs.inject_context(fields(m), params, F.lit(host), F.lit(user)))
    assert call({"x": "1"}, both, "h", "u") == {"x": "1", "hostname": "h", "username": "u"}
    assert call({"hostname": None}, both, "h", "") == {"hostname": None, "username": ""}
    assert call({"x": "1"}, both, "", "u") == {"x": "1", "username": "u"}
    assert call({"x": "1"}, F.array(F.lit("x")), "h", "u") == {"x": "1"}


def test_map_params_later_entry_wins_only_when_it_applies(one):
    mapping = [{"src": "a", "dest": "d"}, {"src": "b", "dest": "d"}, {"dest": "s", "static": "7"}]
    assert one(inputs.map_params(fields({"a": "1", "b": None}), mapping)) == {"d": None, "s": "7"}
    assert one(inputs.map_params(fields({"a": "1"}), mapping)) == {"d": "1", "s": "7"}


def test_fill_defaults_replaces_null_but_not_empty(one):
    assert one(inputs.fill_defaults(fields({"a": None, "b": ""}), {"a": 1, "b": 2, "c": 3})) == {"a": "1", "b": "", "c": "3"}


def test_truthy_fallback(one):
    null = F.lit(None).cast("string")
    assert one(inputs.truthy_fallback(F.lit(""), F.lit("x"))) == "x"
    assert one(inputs.truthy_fallback(null, F.lit(""), F.lit("y"))) == "y"
    assert one(inputs.truthy_fallback(F.lit("a"), F.lit("x"))) == "a"
    assert one(inputs.truthy_fallback(F.lit(""), null)) is None


@pytest.mark.parametrize(
    "url, expected",
    [("http://a/b/c", "https://c"), ("http:/x", "https://x"), ("http|x", "https://http|x"), ("httpsfoo", "httpsfoo"),
     ("HTTP://A/b", "https://HTTP://A/b"), ("a.b/c", "https://a.b/c"), ("https://ok/x", "https://ok/x"),
     ("httpx", "https://httpx"), ("http://a.b", "https://a.b")],
)
def test_normalize_url(one, url, expected):
    assert one(text.normalize_url(F.lit(url))) == expected


def test_scalars(one):
    assert one(text.clamp(F.lit(-1), 0, 3600)) == 0
    assert one(text.clamp(F.lit(4000), 0, 3600)) == 3600
    assert one(text.clamp(F.lit(None).cast("int"), 0, 3600)) is None
    assert one(text.mask_secret(F.lit("A_KEY"), F.lit("abcdef"))) == "abcd..."
    assert one(text.mask_secret(F.lit("A_KEY"), F.lit("ab"))) == "ab..."
    assert one(text.mask_secret(F.lit("A_KEY"), F.lit(""))) is None
    assert one(text.mask_secret(F.lit("key"), F.lit("abcdef"))) == "abcdef"
    assert one(text.empty_to_null(F.lit(""))) is None
    assert one(text.to_millis(F.lit(1_700_000_000), "s")) == one(text.to_millis(F.lit(1_700_000_000_000), "ms"))
    assert one(text.to_millis(F.lit(5), F.lit("ms"))) == 5 and one(text.to_millis(F.lit(5), "h")) is None


@pytest.mark.parametrize(
    "value, expected",
    [("3.00", (3, None)), ("-2.50", (None, -2.5)), ("0.00", (0, None)), ("99999999999999999999.00", (None, 1e20))],
)
def test_narrow_decimal(one, value, expected):
    assert tuple(one(text.narrow_decimal(F.lit(Decimal(value)).cast("decimal(38,2)")))) == expected


@pytest.mark.parametrize(
    "document, expected",
    [
        ('{"byval":{"type":"Buffer","data":[1]},"k":{"type":"Buffer","data":""}}', '{"k":null}'),
        ('[{"type":"Buffer","data":[]},1]', "[null,1]"),
        ('{"type":"Buffer","data":1}', "null"),
        ('{"a":{"b":[{"byval":null,"c":1.5}]}}', '{"a":{"b":[{"c":1.5}]}}'),
        ('{"byval":0,"type":"Buffer"}', '{"byval":0,"type":"Buffer"}'),
        ('{"t":"é","byval":{"byval":null}}', '{"t":"é","byval":{}}'),
        ("{oops", None),
        (None, None),
    ],
)
def test_strip_buffers(spark, document, expected):
    df = spark.createDataFrame([(document,)], "d string")
    assert df.select(strip_buffers("d")).first()[0] == expected


GLOBS = ["*", "*.png", "a?c", "[abc]x", "[!a]x", "a.b", "a+b", "", "*[0-9]", "x*y*z", "[]]x", "(a|b)", "^a$", "[x", "a\\b"]
NAMES = ["", "a.png", "abc", "ax", "bx", "a.b", "aXb", "a+b", "x1y2z", "]x", "(a|b)", "^a$", "[x", "a\\b", "a\nc", "dir/f.png"]


def test_globs(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    rows = df.select("n", *[validate.match_glob(F.col("n"), g).alias(str(i)) for i, g in enumerate(GLOBS)]).collect()
    for row in rows:
        for i, pattern in enumerate(GLOBS):
            assert row[str(i)] == fnmatchcase(row["n"], pattern), (row["n"], pattern)


def test_glob_column(spark):
    plain = [g for g in GLOBS if "[" not in g]
    df = spark.createDataFrame([(n, g) for n in NAMES for g in plain], "n string, g string")
    for row in df.withColumn("hit", validate.match_glob_column(F.col("n"), F.col("g"))).collect():
        assert row["hit"] == fnmatchcase(row["n"], row["g"]), row


def test_missing_required(one):
    env = {"RUN_MODE": "RUN_ACTION", "DYNAMO_TABLE": "", "JOB_ID": "j", "USERNAME": None, "PRIMARY_BUCKET": "b"}
    missing = one(validate.missing_required(fields(env), F.lit("RUN_ACTION")))
    assert missing == ["DYNAMO_TABLE", "USERNAME", "DYNAMO_STREAMS_TABLE", "ACTION_ID"]
    assert one(validate.missing_required(fields({"x": "1"}), F.lit("ELSE"))) == ["RUN_MODE", "DYNAMO_TABLE"]
    assert one(validate.missing_required(fields({"x": "1"}), F.lit(None).cast("string"))) == ["RUN_MODE", "DYNAMO_TABLE"]


def test_rules_do_not_judge_null(one):
    assert one(validate.violations([("n", F.lit(None).cast("int"), {"rule": "GREATER_THAN", "ival": 1})])) == []
    found = one(validate.violations([
        ("n", F.lit(5), {"rule": "LESS_THAN", "ival": 5, "error_message": "too big"}),
        ("n", F.lit(5), {"rule": "LESS_THAN_OR_EQUAL", "ival": 5}),
        ("k", F.lit("a.gif"), {"rule": "ENDS_WITH", "svals": [".png", ".jpg"]}),
    ]))
    assert [(v["name"], v["message"]) for v in found] == [("n", "too big"), ("k", "k fails ENDS_WITH")]


def test_conditionals(one):
    given = {"a": F.lit("1"), "b": F.lit(None).cast("string")}
    assert one(validate.is_active(given, {}, True)) is True
    assert one(validate.is_active(given, {"a": "1", "b": "2"}, True)) is False
    assert one(validate.is_active(given, {"a": "1", "b": "2"}, False)) is True


SAMPLES = {
    "boolean": True, "bigint": 7, "double": 2.5, "string": "x", "array<string>": ["a", "b"],
    "array<double>": [1.0, 2.0], "map<string,string>": {"a": "b"}, "map<string,bigint>": {"a": 1},
}


@pytest.mark.parametrize("tag", sorted(TYPE_OF_TAG))
def test_typed_values_round_trip(spark, tag):
    kind = TYPE_OF_TAG[tag][1]
    if kind not in SAMPLES:
        sql = {
            "binary": "cast('ab' as binary)",
            "timestamp": "timestamp'2024-05-06 07:08:09.123456'",
            "variant": "named_struct('a', 1, 'b', array('x'))",
        }.get(kind, "named_struct('start', timestamp'2024-01-01 00:00:00', 'end', timestamp'2024-01-02 00:00:00')")
        df = spark.sql(f"select {sql} as v")
    else:
        df = spark.createDataFrame([(SAMPLES[kind],)], f"v {kind}")
    encoded = df.select("v", values.encode_value(F.col("v"), tag).alias("e"))
    assert encoded.first()["e"]["ptype"] == tag
    back = values.decode_value(F.col("e"), tag)
    if kind == "variant":
        assert encoded.select(F.to_json(back)).first()[0] == encoded.select(F.to_json("v")).first()[0]
    else:
        row = encoded.select("v", back.alias("b")).first()
        assert row["b"] == row["v"]
    other = "STRING" if tag != "STRING" else "INTEGER"
    assert encoded.select(values.decode_value(F.col("e"), other).isNull()).first()[0]
