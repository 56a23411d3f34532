"""Registered queries of the pipeline operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowloom.llm import divergence, exact, jaccard, licenses, merkle, mixing, ordinal, periodic, pii, piece, suffix, templates, tokenfile
from rowloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql.strip()
        return build

    return register


@query("op10_quality_classifier")
def op10(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return ordinal.select(docs.select("doc_id", "text"), labels).drop("text")


@query(
    "op5_exact_dedup",
    r"""
    WITH digests AS (
        SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
        FROM documents),
    ranked AS (
        SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept,
               (SELECT min(doc_id) + (max(doc_id) - min(doc_id)) // 2 FROM documents) AS middle
        FROM digests)
    SELECT doc_id, keep_id, group_size, kept, text_sha256, doc_id > middle AND keep_id <= middle AS repeat FROM ranked
    """,
)
def op5(spark, sf_dir):
    return exact.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op2_piece_encoding")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece.encode_digests(docs, piece_model()).drop("text")


def piece_model() -> str:
    """The model file of the queries; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op9_ngram_jaccard")
def op9(spark, sf_dir):
    return jaccard.connected(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op6_mixing")
def op6(spark, sf_dir):
    languages = {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.11}
    return mixing.mix(table(spark, sf_dir, "documents"), share=0.5, languages=languages)


@query("op4_pii")
def op4(spark, sf_dir):
    return pii.summary(table(spark, sf_dir, "documents"))


@query("op7_url_templates")
def op7(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return templates.judge(pages, templates.labels_from_html(pages))


@query("op3_quality_divergence")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return divergence.judge(docs).drop("text", "lang")


def _license_sql() -> str:
    """The scan in SQL. The known texts are the operator's; the patterns are written out here."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    spellings = [
        ("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("per cent", "percent"),
        ("copyright holder", "copyright owner"), ("https://", "http://"), ("organisation", "organization"),
        ("merchantibility", "merchantability"), ("whilst", "while"), ("gnu gpl", "gnu general public license"),
        ("creative commons by", "cc by"),
    ]

    def lower(x: str) -> str:
        return f"translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def canonical(x: str) -> str:
        of_copyright = (
            "(regexp_matches(line, 'copyright|[(]c[)]|©') AND (regexp_matches(line, '[0-9][0-9][0-9][0-9]') "
            "OR regexp_matches(line, '^ *(©|copyright ([(]c[)]|©|by ))')))"
        )
        lines = f"list_filter(string_split({lower(x)}, chr(10)), lambda line: NOT {of_copyright})"
        x = f"array_to_string({lines}, chr(10))"
        for spelling, common in spellings:
            x = f"replace({x}, {quote(spelling)}, {quote(common)})"
        return rf"trim(regexp_replace({x}, '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+', ' ', 'g'))"

    known = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in licenses.TEXTS + licenses.NOTICES)
    return f"""
    WITH known AS (
        SELECT sha256({canonical("text")}) AS digest, min(name) AS license
        FROM (VALUES {known}) AS t(name, text) GROUP BY 1),
    docs AS (
        SELECT doc_id, row_number() OVER () AS n, text, sha256({canonical("text")}) AS canonical_sha256 FROM documents),
    lines AS (
        SELECT n, unnest(string_split(text, chr(10))) AS line FROM docs),
    notices AS (
        SELECT n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
        FROM (SELECT n, sha256({canonical("line")}) AS digest FROM lines
              WHERE regexp_matches({lower("line")}, 'licen[cs]e|rights reserved')) JOIN known USING (digest)
        GROUP BY n)
    SELECT doc_id, canonical_sha256, license, coalesce(notices, '') AS notices
    FROM docs LEFT JOIN known ON digest = canonical_sha256 LEFT JOIN notices USING (n)
    """


@query("op1_license_scan", _license_sql())
def op1(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.prepare_catalog(spark))


@query("op8_suffix_tree")
def op8(spark, sf_dir):
    return suffix.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op13_token_files")
def op13(spark, sf_dir):
    return tokenfile.round_trip(table(spark, sf_dir, "documents"), word_model())


def word_model() -> str:
    """The tokenizer file of the query; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _manifest_sql(levels: int = 6) -> str:
    """The manifest in SQL: trees of up to 16 to the power of ``levels`` leaves, a level a step."""

    def digest(text: str) -> str:
        marked = lambda x: f"coalesce(octet_length(encode({x})) || ':' || {x}, '-')"
        return f"sha256({' || '.join(marked(x) for x in ('doc_id::VARCHAR', 'source', 'lang', 'n_chars::VARCHAR', text))})"

    def tree(name: str, first: str) -> list[str]:
        """Levels of nodes (key, pos, digest, n), and each with its siblings left and right."""
        made = [f"{name}0 AS ({first})"]
        for k in range(levels):
            side = "string_agg(digest, '') OVER (PARTITION BY key, pos // 16 ORDER BY pos ROWS BETWEEN {})"
            made.append(
                f"{name}_steps{k} AS (SELECT key, pos, n, coalesce({side.format('UNBOUNDED PRECEDING AND 1 PRECEDING')}, '') AS l, "
                f"coalesce({side.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')}, '') AS r FROM {name}{k})"
            )
            made.append(
                f"{name}{k + 1} AS (SELECT key, pos // 16 AS pos, CASE WHEN n = 1 THEN min(digest) "
                f"ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest, (n + 15) // 16 AS n "
                f"FROM {name}{k} GROUP BY key, pos // 16, n)"
            )
        return made

    def climb(name: str, source: str, key: str, pos: str) -> list[str]:
        """Rows of ``source`` (with f and proof) taken through the steps of a tree."""
        made = []
        for k in range(levels):
            made.append(
                f"{name}_up{k} AS (SELECT d.* EXCLUDE (f, proof), CASE WHEN s.n = 1 THEN f ELSE sha256(l || f || r) END AS f, "
                f"proof || l || r AS proof FROM {source} d JOIN {name}_steps{k} s "
                f"ON s.key IS NOT DISTINCT FROM d.{key} AND s.pos = d.{pos} // {16**k})"
            )
            source = f"{name}_up{k}"
        return made

    steps = [
        """crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) AS r(i)))""",
        f"""leaves AS (SELECT doc_id, source, {digest("text")} AS leaf,
            {digest("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS tampered,
            xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''),
                lambda x: ascii(x)::BIGINT)), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) AS crc
            FROM documents, crc_table)""",
        """ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
            count(*) OVER (PARTITION BY source) AS n, '' AS proof,
            CASE WHEN crc % 5 = 0 THEN tampered ELSE leaf END AS f FROM leaves)""",
        *tree("docs", "SELECT source AS key, pos, leaf AS digest, n FROM ranked"),
        f"""tops AS (SELECT key AS source, digest AS subroot, row_number() OVER (ORDER BY encode(key) NULLS FIRST) - 1 AS place,
            count(*) OVER () AS sources FROM docs{levels})""",
        *tree("roots", "SELECT 0 AS key, place AS pos, subroot AS digest, sources AS n FROM tops"),
        *climb("docs", "ranked", "source", "pos"),
        f"""subrooted AS (SELECT d.*, subroot, place, 0 AS one FROM docs_up{levels - 1} d
            JOIN tops ON tops.source IS NOT DISTINCT FROM d.source)""",
        *climb("roots", "subrooted", "one", "place"),
    ]
    return f"""
    WITH {", ".join(steps)}
    SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = digest AS verified
    FROM roots_up{levels - 1}, roots{levels}
    """


@query("op11_merkle_manifest", _manifest_sql())
def op11(spark, sf_dir):
    return merkle.audit(table(spark, sf_dir, "documents"))


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    return periodic.report(table(spark, sf_dir, "documents"))
