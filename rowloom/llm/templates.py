"""URL filters: rules first, then a tree of path templates judged by labelled purity.

Rules name a host (with its subdomains) and the beginning of a path; the longest that fits
decides. The other urls are judged by templates. The tree of a host has a level per path
segment. On the way down a segment stays as it is where it is frequent among its siblings;
the rare ones (numbers, names, slugs) become ``*``. Sibling branches whose labelled rates of
bad urls don't differ by more than chance are merged (``{de,fr}``). A template is rejected
when its smoothed share of bad labels, drawn towards the host's share and that towards the
share of all, reaches ``impure`` and enough labels stand behind it.

A level is two aggregations and two joins over all urls, keyed by host and template so far;
a hot host's rows are folded before each shuffle, and its join is split by adaptive skew
handling. ``DEPTH`` levels are told apart, the rest of a path counts as one segment.

Cases: a null url, or one without ``://``, has an empty host and path and is allowed unless
a template of the empty host is impure. Urls without labels count for the templates, not for
purity. Several labels of a url: any bad one counts. Repeated rows are judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowloom.llm.common import prepare
from rowloom.session import materialise

DEPTH = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def written(self) -> str:
        return self.host + self.path


#: the contract's rules
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    url = F.col(url) if isinstance(url, str) else url
    place = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(place > 0, F.substr(url, place + 3)).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def fitting(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.written)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, r.written).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def _segments(path: Column) -> Column:
    """Segments of a path; those beyond ``DEPTH`` are one."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    tail = F.array_join(F.slice(parts, DEPTH, F.greatest(F.size(parts), F.lit(1))), "/")
    return F.when(F.size(parts) <= DEPTH, parts).otherwise(F.concat(F.slice(parts, 1, DEPTH - 1), F.array(tail)))


def templates(pages: DataFrame, least_share: float, least_count: int, chance: float) -> DataFrame:
    """``pages`` (row, host, path, bad) with ``template``.

    ``bad``: 1, 0 or null. A segment stays where it has ``least_share`` of its node's urls and
    ``least_count`` of them. Neighbours in order of their bad rate are merged while they
    differ by less than ``chance`` standard errors.
    """
    rows = pages.withColumn("parts", _segments(F.col("path"))).withColumn("template", F.lit(""))
    for level in range(DEPTH):
        here = rows.withColumn("segment", F.get("parts", F.lit(level)))
        node = ["host", "template"]
        counts = here.where("segment IS NOT NULL").groupBy(*node, "segment")
        counts = counts.agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("judged"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bads"))
        counts = materialise(counts, "segments")
        totals = counts.groupBy(*node).agg(F.sum("n").alias("total"))
        stay = counts.join(totals, node).where((F.col("n") >= least_count) & (F.col("n") >= least_share * F.col("total")))
        merged = _merge(stay, node, chance)
        named = here.join(merged, [*node, "segment"], "left")
        step = F.when(F.col("segment").isNull(), "").otherwise(F.concat(F.lit("/"), F.coalesce("branch", F.lit("*"))))
        rows = named.withColumn("template", F.concat("template", step)).drop("segment", "branch")
        rows = materialise(rows, "templates")
    return rows.drop("parts")


def _merge(stay: DataFrame, node: list[str], chance: float) -> DataFrame:
    """(node, segment, branch): segments that stay, those of similar bad rates under one name.

    A node has at most 1/least_share of them, so its window is small."""
    rate = (F.col("bads") + 0.5) / (F.col("judged") + 1.0)
    ordered = Window.partitionBy(*node).orderBy("rate", "segment")
    rows = stay.withColumn("rate", rate).withColumn("noise", F.col("rate") * (1 - F.col("rate")) / (F.col("judged") + 1.0))
    gap = (F.col("rate") - F.lag("rate").over(ordered)) / F.sqrt(F.col("noise") + F.lag("noise").over(ordered))
    unlike = F.coalesce(gap > chance, F.lit(False)) | (F.lag("judged").over(ordered) == 0) | (F.col("judged") == 0)
    rows = rows.withColumn("group", F.sum(F.coalesce(unlike, F.lit(True)).cast("int")).over(ordered))
    members = rows.groupBy(*node, "group").agg(F.sort_array(F.collect_list("segment")).alias("m"))
    many = F.concat(F.lit("{"), F.array_join("m", ","), F.lit("}"))
    members = members.withColumn("branch", F.when(F.size("m") > 1, many).otherwise(F.get("m", F.lit(0))))
    return members.select(*node, F.explode("m").alias("segment"), "branch")


def judge(
    pages: DataFrame,
    labels: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    least_share: float = 0.05,
    least_count: int = 4,
    chance: float = 2.0,
    strength: float = 10.0,
    impure: float = 0.6,
    least_labels: int = 5,
) -> DataFrame:
    """Per row of ``pages`` (page_id, url): host, path, rule, verdict, template, purity, n_labels.

    ``labels``: (page_id, bad). ``purity`` is the smoothed share of bad labels.
    """
    prepare(pages.sparkSession)
    host, path = host_and_path("url")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = labels.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    rows = materialise(rows.join(known, "page_id", "left"), "pages")
    rows = templates(rows, least_share, least_count, chance)
    sums = [F.count("bad").alias("judged"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bads")]
    by_template = materialise(rows.groupBy("host", "template").agg(*sums), "template-counts")
    by_host = by_template.groupBy("host").agg(F.sum("judged").alias("host_judged"), F.sum("bads").alias("host_bads"))
    all_ = by_template.agg(F.sum("judged"), F.sum("bads")).first()
    share = (all_[1] or 0) / all_[0] if all_[0] else 0.0
    host_share = (F.col("host_bads") + strength * share) / (F.col("host_judged") + strength)
    purity = (F.col("bads") + strength * host_share) / (F.col("judged") + strength)
    judged = by_template.join(by_host, "host").select("host", "template", F.col("judged").alias("n_labels"), purity.alias("purity"))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    by_tree = F.when((F.col("n_labels") >= least_labels) & (F.col("purity") >= impure), "block").otherwise("allow")
    return rows.join(judged, ["host", "template"]).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_tree).alias("verdict"), "template", "purity", "n_labels"
    )


def _without(html: Column, tag: str) -> Column:
    """``html`` without elements of a tag, in one pass: from each opening to the next closing."""
    pieces = F.split(html, f"<{tag}\\b")
    after = lambda piece: F.instr(piece, f"</{tag}>")
    kept = lambda piece: F.when(after(piece) > 0, F.substr(piece, after(piece))).otherwise(F.lit(""))
    rest = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), kept)
    return F.when(F.size(pieces) > 1, F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, " "))).otherwise(html)


def labels_from_html(pages: DataFrame, symbols: int = 3) -> DataFrame:
    """Bad pages by what they show: those with no words, or with ``symbols`` percent or more of
    their characters (without blanks) among ``#*$%&|<>``. Scripts, styles and tags aren't shown.
    All steps are linear in the page, whatever it holds."""
    shown = _without(_without(F.coalesce("html", F.lit("")), "script"), "style")
    shown = F.regexp_replace(shown, r"<[^<>]*+>|&[a-z]++;", " ")
    dense = F.regexp_replace(shown, r"[\x20\x09-\x0D]++", "")
    junk = F.length(dense) - F.length(F.regexp_replace(dense, r"[#*$%&|<>]++", ""))
    return pages.select("page_id", (100 * junk >= symbols * F.length(dense)).alias("bad"))
