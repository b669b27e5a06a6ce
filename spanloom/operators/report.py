"""Reports of results as text, JSON and HTML columns. Results have text, summary, facts, chunks_used."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import html_escape, is_claim_like, line_of, shorten, squeeze, strip
from .metrics import all_spans, coverage

#: The width and the wording of the text report, as format strings.
WIDTH = 88
HEADS = ("SUMMARY", "FACTS AND SOURCES")
SPAN_LINE = "      -> chunk %d, chars %d-%d, line %d"
NO_SOURCE = "      (no citation attached)"
DECLINED = "Request declined by the model: "
ATTRIBUTION = "attribution: %d/%d claims cited, %d%% of summary text inside a cited span"
RETRIEVAL = "retrieval:   %d chunks used, %d source spans cited"


def merge_spans(spans: DataFrame, *keys: str) -> DataFrame:
    """(keys..., slot, start, end, n_spans): spans that overlap or touch, as one, numbered by place.

    ``spans`` has the keys, start and end. A span opens a new slot if it starts after the largest end
    before it; the slot number is the running count of openings.
    """
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("__open", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    slot = F.sum("__open").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return opened.withColumn("slot", slot).groupBy(*keys, "slot").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_spans"))


def merged_array(spans: Column) -> Column:
    """The same inside a row: an array of (start, end), by a fold over the sorted spans."""
    pairs = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    none = F.filter(pairs, lambda p: F.lit(False))

    def add(held: Column, p: Column) -> Column:
        last = F.element_at(held, F.size(held))
        longer = F.concat(F.slice(held, 1, F.size(held) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], p["end"]).alias("end"))))
        return F.when(F.size(held) == 0, F.array(p)).when(p["start"] <= last["end"], longer).otherwise(F.concat(held, F.array(p)))

    return F.aggregate(pairs, none, add)


def visible_facts(facts: Column) -> Column:
    """Facts but for connective fragments that have no source."""
    return F.filter(facts, lambda f: is_claim_like(f["text"]) | (F.size(f["sources"]) > 0))


def _footer(facts: Column, chunks: Column) -> tuple[Column, Column]:
    claims = F.filter(facts, lambda f: is_claim_like(f["text"]))
    return F.size(F.filter(claims, lambda f: F.size(f["sources"]) > 0)), F.size(claims)


def to_text(results: DataFrame, show_spans: bool = True, width: int = WIDTH) -> DataFrame:
    """``results`` plus ``report``: the summary, then numbered facts; ! marks those without a source."""
    facts, text = F.col("facts"), F.col("text")

    def source(s: Column) -> Column:
        where = F.format_string(SPAN_LINE, s["chunk_ix"], s["start"], s["end"], line_of(text, s["start"]))
        quote = F.concat(F.lit('\n         "'), shorten(squeeze(s["cited_text"]), width - 12, width - 15), F.lit('"'))
        return F.concat(where, quote) if show_spans else where

    def one(f: Column, k: Column) -> Column:
        cited = F.size(f["sources"]) > 0
        head = F.concat(F.lit("\n"), F.when(cited, " ").otherwise("!"), F.format_string("[%d] ", k + 1), strip(f["text"]))
        below = F.when(cited, F.array_join(F.transform(f["sources"], source), "\n")).otherwise(NO_SOURCE)
        return F.concat_ws("\n", head, below)

    rule, (cited, claims) = F.lit("=" * width), _footer(facts, F.col("chunks_used"))
    attribution = F.format_string(ATTRIBUTION, cited, claims, F.bround(coverage(facts) * 100).cast("int"))
    retrieval = F.format_string(RETRIEVAL, F.size("chunks_used"), F.size(all_spans(facts)))
    if "usage" in results.columns:
        count = lambda c: F.format_string("%,d", F.coalesce(F.col(f"usage.{c}"), F.lit(0)))
        used = F.when(F.col("usage").isNotNull(), F.concat(F.lit("tokens:      "), count("input_tokens"), F.lit(" in / "), count("output_tokens"), F.lit(" out")))
    else:
        used = F.when(F.size(facts) > 0, F.lit("tokens:      0 in / 0 out"))
    body = F.concat_ws(
        "\n", rule, F.lit(HEADS[0]), rule, strip(F.col("summary")), F.lit(""), rule, F.lit(HEADS[1]), rule,
        F.when(F.size(visible_facts(facts)) > 0, F.array_join(F.transform(visible_facts(facts), one), "\n")), F.lit(""), rule, attribution, retrieval, used,
    )
    if "refusal" in results.columns:
        body = F.when(F.col("refusal").isNotNull(), F.concat(F.lit(DECLINED), "refusal")).otherwise(body)
    return results.withColumn("report", body)


def to_json(results: DataFrame) -> DataFrame:
    """``results`` plus ``json``: summary, coverage, chunks, and facts whose sources have their line."""
    text = F.col("text")
    source = lambda s: F.struct(
        s["cited_text"].alias("cited_text"), s["chunk_ix"].alias("chunk_index"), s["start"].alias("start"), s["end"].alias("end"),
        line_of(text, s["start"]).alias("line"),
    )
    fact = lambda f: F.struct(f["text"].alias("text"), (F.size(f["sources"]) > 0).alias("grounded"), F.transform(f["sources"], source).alias("sources"))
    chunk = lambda c: F.struct(c["ix"].alias("index"), c["start"].alias("start"), c["end"].alias("end"))
    extra = [F.col(c) if c in results.columns else F.lit(None).cast("string").alias(c) for c in ("stop_reason", "refusal", "usage")]
    whole = F.struct(
        "summary", coverage(F.col("facts")).alias("coverage"), *extra,
        F.transform("chunks_used", chunk).alias("chunks_used"), F.transform("facts", fact).alias("facts"),
    )
    return results.withColumn("json", F.to_json(whole, {"pretty": "true", "ignoreNullFields": "false"}))


PAGE_STYLE = """
body{margin:0;font:15px/1.6 system-ui,sans-serif;color:#1c1c1c;background:#fff}
main{display:flex;gap:2rem;padding:1.5rem}article{flex:1;min-width:0}
.source{max-height:80vh;overflow:auto}mark{background:#ffe9a8}mark:target,mark.on{background:#ffb84d}
.claim:hover{background:#ffe9a8}sup a{text-decoration:none}
"""


def to_html(results: DataFrame, title: str = "Document summary") -> DataFrame:
    """``results`` plus ``html``: a page where each claim points at the marked part of the source."""
    facts, text = F.col("facts"), F.col("text")
    df = results.withColumn("__m", merged_array(all_spans(facts)))
    merged = F.col("__m")
    slot_of = lambda s: F.size(F.filter(merged, lambda m: m["start"] <= s["start"])) - 1
    escaped = lambda a, b: html_escape(F.substring(text, a + 1, b - a))

    def marked(m: Column, k: Column) -> Column:
        before = F.when(k > 0, F.get(merged, k - 1)["end"]).otherwise(0)
        return F.concat(escaped(before, m["start"]), F.format_string('<mark id="s%d" class="src">', k), escaped(m["start"], m["end"]), F.lit("</mark>"))

    rest = F.coalesce(F.element_at(F.transform(merged, lambda m: m["end"]), F.when(F.size(merged) > 0, -1)), F.lit(0))
    source = F.replace(F.concat(F.array_join(F.transform(merged, marked), ""), escaped(rest, F.length(text))), F.lit("\n"), F.lit("<br>"))

    def claim(f: Column) -> Column:
        slots = F.array_sort(F.array_distinct(F.transform(f["sources"], slot_of)))
        refs = F.array_join(F.transform(slots, lambda t: F.format_string('<a href="#s%d" class="cite" data-target="s%d">%d</a>', t, t, t + 1)), " ")
        names = F.array_join(F.transform(slots, lambda t: F.concat(F.lit("s"), t.cast("string"))), ",")
        linked = F.concat(F.lit('<span class="claim" data-refs="'), names, F.lit('">'), html_escape(f["text"]), F.lit("</span><sup>"), refs, F.lit("</sup>"))
        return F.when(F.size(f["sources"]) > 0, linked).otherwise(html_escape(f["text"]))

    cited, claims = _footer(facts, F.col("chunks_used"))
    meta = F.format_string("%d/%d claims cited &middot; %d chunks retrieved &middot; %d source spans", cited, claims, F.size("chunks_used"), F.size(all_spans(facts)))
    name = html_escape(F.lit(title))
    page = F.concat(
        F.lit('<!doctype html>\n<meta charset="utf-8">\n<title>'), name, F.lit(f"</title>\n<style>{PAGE_STYLE}</style>\n<header><h1>"), name,
        F.lit('</h1><p class="meta">'), meta, F.lit('</p></header>\n<main><article class="summary">'), F.array_join(F.transform(facts, claim), ""),
        F.lit('</article><article class="source">'), source, F.lit("</article></main>\n"),
    )
    return df.withColumn("html", page).drop("__m")


def page_name(doc_id: object) -> str:
    """The file name of a document's page: characters that no file system takes become underscores."""
    return re.sub(r"[^\w.\-]", "_", str(doc_id)) + ".html"


def write_pages(results: DataFrame, path: str, title: str = "Document summary") -> None:
    """One file ``{doc_id}.html`` for each document in a folder of this machine; pages pass through one at a time.

    For a folder that a cluster shares, write the column of :func:`to_html` with Spark.
    """
    os.makedirs(path, exist_ok=True)
    for row in to_html(results, title).select("doc_id", "html").toLocalIterator():
        with open(os.path.join(path, page_name(row["doc_id"])), "w", encoding="utf-8") as file:
            file.write(row["html"])


def format_table(rows: list[dict], columns: list[str]) -> str:
    """A console table of a few collected rows."""
    cells = [columns, *[["" if r.get(c) is None else str(r[c]) for c in columns] for r in rows]]
    widths = [max(len(r[k]) for r in cells) for k in range(len(columns))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in cells]
    return "\n".join([lines[0], "  ".join("-" * w for w in widths), *lines[1:]])
