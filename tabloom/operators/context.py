"""What the text of a paper says about a table: passages by terms, sentence windows, and variables named in several places."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.text import SPACE, clean_text, label_text
from tabloom.operators.documents import term_hits
from tabloom.runtime import checkpoint

# What methods and results add to a passage's score, and how many passages a table keeps.
BONUS = {"methods_like": 0.2, "results_like": 0.1}
PASSAGES = 8
SUMMARY_SUFFIX = r"(?i)[ ,–-]*(?:\b(?:n|no\.?) *\( *% *\)|\b(?:mean|median) *(?:\( *(?:sd|iqr|se) *\)|± *s[de]))$"

# A mention of a table or figure with its numbers, one number, where a sentence ends, and table bodies in the text.
_NUMBER = r"(?=[A-Za-z0-9.]*\d)[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)*"
_MENTION = re.compile(rf"\b(Table|Tables|Fig\.?|Figs\.?|Figure|Figures)\s*({_NUMBER}(?:\s*(?:,|and|&)\s*{_NUMBER}){{0,8}})\b", re.IGNORECASE)
_ONE_NUMBER = re.compile(_NUMBER)
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9])")
_TABLE_BODY = re.compile(r"\bTable\s+[A-Za-z]?\d+[A-Za-z]?\b(?=.{0,240}\|)", re.IGNORECASE)
_CUE = re.compile(r"\b(?:shown|presented|reported|summari[sz]ed|listed|described|displayed|provided|given|seen)\s+in\s*$|\b(?:see|refer\s+to|according\s+to)\s*$", re.IGNORECASE)
_RULE = re.compile(r"\|\s*-{3,}\s*\|")


def canonical_label(label: Column) -> Column:
    """A variable's label without what it says of the summary, of units in brackets at the end, and of note marks."""
    out = F.regexp_replace(clean_text(label), r"[*†‡§¶#]+", "")
    out = F.regexp_replace(F.trim(out), SUMMARY_SUFFIX, "")
    out = F.regexp_replace(F.trim(out), r" *[(\[][^()\[\]]{1,20}[)\]]$", "")
    return F.trim(F.regexp_replace(out, r"[ ,;:]+$", ""))


def table_context(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(table_id, doc_id, score, rank): the passages of methods and results that hold most of a table's terms.

    ``terms``: paper_id, table_id, term. The score is the share of the table's terms held, plus BONUS of the role; the
    best PASSAGES are kept, ties by document id. Only documents that hold a term are ever paired with its tables.
    """
    held = term_hits(docs.where(F.col("role_hint").isin(list(BONUS))), terms)
    own = terms.select("paper_id", "table_id", "term").distinct()
    sizes = own.groupBy("table_id").agg(F.count("*").alias("n_terms"))
    counts = held.join(own, ["paper_id", "term"]).groupBy("table_id", "doc_id").agg(F.count("*").alias("n_held")).join(sizes, "table_id")
    roles = docs.select("doc_id", "role_hint")
    bonus = F.when(F.col("role_hint") == "methods_like", BONUS["methods_like"]).otherwise(BONUS["results_like"])
    scored = counts.join(roles, "doc_id").withColumn("score", F.round(F.col("n_held") / F.col("n_terms") + bonus, 4))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("table_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= PASSAGES).select("table_id", "doc_id", "score", "rank")


def table_passages(docs: DataFrame, terms: DataFrame, numbers: DataFrame) -> DataFrame:
    """(table_id, doc_id, match_type, score, rank): documents that name the table, whatever their role, and those that hold its terms.

    ``numbers``: paper_id, table_id, number. A document that names the table's number scores 1.0 and isn't scored by terms;
    others of methods and results score as in ``table_context``. The best PASSAGES are taken, ties by document id, and of
    those with the same text the first is kept, so that a table may keep fewer; ranks stay as they were.
    """
    papers = docs.where("paper_id is not null and text is not null").select("doc_id", "paper_id", "role_hint", F.sha2("text", 256).alias("text_hash")).distinct()
    said = reference_windows(docs).where("reference_kind = 'table'").select("doc_id", F.col("reference_number").alias("number")).distinct()
    own_number = numbers.where("number is not null").select("paper_id", "table_id", F.upper("number").alias("number")).distinct()
    named = said.join(papers.select("doc_id", "paper_id"), "doc_id").join(own_number, ["paper_id", "number"]).select("table_id", "doc_id").distinct()
    own = checkpoint(terms.select("paper_id", "table_id", "term").where("term <> ''").distinct())
    sizes = own.groupBy("table_id").agg(F.count("*").alias("n_terms"))
    held = term_hits(docs.where(F.col("role_hint").isin(list(BONUS))), own).join(own, ["paper_id", "term"]).groupBy("table_id", "doc_id").agg(F.count("*").alias("n_held"))
    bonus = F.when(F.col("role_hint") == "methods_like", BONUS["methods_like"]).otherwise(BONUS["results_like"])
    match = F.when(F.col("role_hint") == "methods_like", "methods_term_match").otherwise("results_term_match")
    by_terms = held.join(named, ["table_id", "doc_id"], "left_anti").join(sizes, "table_id").join(papers, "doc_id").select("table_id", "doc_id", match.alias("match_type"), F.round(F.col("n_held") / F.col("n_terms") + bonus, 4).alias("score"))
    both = named.select("table_id", "doc_id", F.lit("table_reference").alias("match_type"), F.lit(1.0).alias("score")).unionByName(by_terms)
    best = both.withColumn("rank", F.row_number().over(Window.partitionBy("table_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= PASSAGES)
    texts = best.join(papers.select("doc_id", "text_hash"), "doc_id")
    again = F.row_number().over(Window.partitionBy("table_id", "text_hash").orderBy("rank"))
    return texts.withColumn("again", again).where("again = 1").select("table_id", "doc_id", "match_type", "score", "rank")


def sentence_windows(docs: DataFrame, pattern: str = r"\bTable +S?[0-9]+") -> DataFrame:
    """(doc_id, sentence, anchor): the first sentence with a match, and it with its neighbours. ``reference_windows`` has all."""
    sentences = F.split(F.regexp_replace(clean_text(F.col("text")), r"([.?!]) +", "$1\n"), "\n")
    s = docs.where("text is not null").select("doc_id", sentences.alias("s"))
    at = F.array_position(F.transform("s", lambda x: x.rlike(pattern)), True)
    found = s.withColumn("at", at).where("at > 0")
    start = F.greatest(F.col("at") - 1, F.lit(1)).cast("int")
    size = (F.least(F.col("at") + 1, F.size("s")) - start + 1).cast("int")
    return found.select("doc_id", F.get("s", (F.col("at") - 1).cast("int")).alias("sentence"), F.array_join(F.slice("s", start, size), " ").alias("anchor"))


def _prose(chunk: str) -> str:
    """A cleaned paragraph without the table body it holds; blank if it is one."""
    is_body = lambda t: t.count("|") >= 8 or _RULE.search(t) is not None
    for start in _TABLE_BODY.finditer(chunk):
        if not _CUE.search(chunk[max(0, start.start() - 120) : start.start()].strip()) and is_body(chunk[start.start() :]):
            chunk = chunk[: start.start()].strip()
            break
    return "" if is_body(chunk) else chunk


def _windows(paragraph: str) -> Iterator[tuple[str, str, str, int, int, int, str]]:
    """(kind, number, matched, sentence, start, end, anchor) of each number mentioned; start and end count from the anchor's start."""
    cuts = [0]
    for end in _SENTENCE_END.finditer(paragraph):
        cuts += [end.start(), end.end()]
    cuts.append(len(paragraph))
    spans = list(zip(cuts[::2], cuts[1::2]))
    at = 0
    for found in _MENTION.finditer(paragraph):
        while at < len(spans) - 1 and found.start() >= spans[at + 1][0]:
            at += 1
        first, last = spans[max(0, at - 1)][0], spans[min(len(spans) - 1, at + 1)][1]
        kind = "table" if found.group(1).lower().startswith("table") else "figure"
        for number in _ONE_NUMBER.findall(found.group(2)):
            yield kind, number.upper(), found.group(0), at, found.start() - first, found.end() - first, paragraph[first:last]


def reference_windows(docs: DataFrame) -> DataFrame:
    """One row per mention of a table or figure number in a document's prose, with its sentence and the neighbours of it.

    (doc_id, paragraph_index, reference_index, reference_kind, reference_number, matched_text, sentence_index, start_char,
    end_char, anchor_text). A mention of several numbers gives a row for each; start_char and end_char count from the
    anchor's start. Windows stay in their paragraph; a heading and table bodies in the text are no prose. A document's
    repeats are kept; null texts give none.
    """
    names = ["paragraph_index", "reference_index", "reference_kind", "reference_number", "matched_text", "sentence_index", "start_char", "end_char", "anchor_text"]
    types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for row, chunks in enumerate(batch.column("chunks").to_pylist()):
                for index, paragraph in enumerate(p for p in map(_prose, chunks) if p):
                    found = [(index, k, *w) for k, w in enumerate(_windows(paragraph))]
                    rows += found
                    owner += [row] * len(found)
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner, pa.int64())), *(pa.array(list(c), t) for c, t in zip(columns, types))], names=["doc_id", *names])

    first = F.trim(F.element_at(F.split("text", "\n"), 1))
    headed = (F.length(first) <= 40) & first.rlike("^[A-Za-z][A-Za-z ]*$")
    content = F.when(headed, F.regexp_replace("text", r"\A[^\n]*(?:\n|\z)", "")).otherwise(F.col("text"))
    chunks = F.filter(F.transform(F.split(content, rf"\n{SPACE}*\n"), clean_text), lambda c: c != "")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, paragraph_index int, reference_index int, reference_kind string, reference_number string, matched_text string, sentence_index int, start_char int, end_char int, anchor_text string"
    return docs.where("text is not null").select("doc_id", chunks.alias("chunks")).mapInArrow(run, schema)


def variable_inventory(variables: DataFrame, tables: DataFrame, docs: DataFrame) -> DataFrame:
    """(paper_id, label, n_tables, n_docs, promoted): names of variables per paper, in how many tables and documents.

    promoted: named in two or more tables, or in a table and the text.
    """
    papers = tables.select("table_id", "paper_id").distinct()
    named = variables.where("variable_label is not null").withColumn("label", F.lower(label_text(canonical_label(F.col("variable_label"))))).where("label <> ''").join(papers, "table_id")
    per_paper = named.groupBy("paper_id", "label").agg(F.countDistinct("table_id").alias("n_tables"))
    in_text = term_hits(docs, per_paper.select("paper_id", F.col("label").alias("term"))).groupBy("paper_id", F.col("term").alias("label")).agg(F.countDistinct("doc_id").alias("n_docs"))
    out = per_paper.join(in_text, ["paper_id", "label"], "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
    return out.withColumn("promoted", (F.col("n_tables") >= 2) | (F.col("n_docs") > 0))


#: What a mention's source says for a variable; texts by their role.
SOURCE_WEIGHT = {"table_variable_name": 0.85, "table_variable_label": 0.8, "table_caption": 0.72, "table_grouping_label": 0.7}
TEXT_WEIGHT = {"abstract_like": 1.0, "methods_like": 0.95, "conclusion_like": 0.9, "discussion_like": 0.85, "results_like": 0.65, "references_like": 0.0}
OTHER_TEXT, PRIORITY_ROLES = 0.35, ["abstract_like", "methods_like", "conclusion_like", "discussion_like"]


def variable_candidates(variables: DataFrame, classes: DataFrame, tables: DataFrame, groupings: DataFrame, docs: DataFrame) -> DataFrame:
    """Variables of each paper with what supports them: counts by source, promotion_basis, priority_score and confidence.

    Mentions are names and labels of variables, captions that hold a label, grouping labels and documents. A candidate is
    kept if it has a variable's name, the support of a prominent section, two kinds of source, or a table and the text.
    ``classes``: variable_id, mention_class; levels, bins and artifacts are no mentions. A document counts once.
    """
    papers = tables.groupBy("table_id").agg(F.min("paper_id").alias("paper_id"), F.min("caption").alias("caption")).where("paper_id is not null")
    good = classes.where("mention_class in ('variable', 'unknown')").select("variable_id").distinct()
    own = variables.join(good, "variable_id", "left_semi").join(papers.select("table_id", "paper_id"), "table_id")
    key = lambda label: F.lower(label_text(canonical_label(F.col(label))))
    named = [own.select("paper_id", key(c).alias("key"), F.lit(f"table_{c}").alias("source"), F.col("table_id").alias("place"), F.lit("").alias("role")) for c in ("variable_name", "variable_label")]
    labels = named[1].where("length(replace(key, ' ', '')) >= 3").select("paper_id", F.col("key").alias("term")).distinct()
    in_captions = term_hits(papers.select("paper_id", F.col("table_id").alias("doc_id"), F.col("caption").alias("text")), labels).select("paper_id", F.col("term").alias("key"), F.lit("table_caption").alias("source"), F.col("doc_id").alias("place"), F.lit("").alias("role"))
    grouped = groupings.join(papers.select("table_id", "paper_id"), "table_id").select("paper_id", F.lower(label_text(F.col("grouping_label"))).alias("key"), F.lit("table_grouping_label").alias("source"), F.col("table_id").alias("place"), F.lit("").alias("role"))
    roles = docs.select("doc_id", F.coalesce("role_hint", F.lit("other")).alias("role")).distinct()
    in_text = term_hits(docs, labels).join(roles, "doc_id").select("paper_id", F.col("term").alias("key"), F.lit("text_based").alias("source"), F.col("doc_id").cast("string").alias("place"), "role")
    mentions = named[0]
    for more in (named[1], in_captions, grouped, in_text):
        mentions = mentions.unionByName(more)
    weight = F.lit(OTHER_TEXT)
    for name, worth in TEXT_WEIGHT.items():
        weight = F.when(F.col("role") == name, worth).otherwise(weight)
    for name, worth in SOURCE_WEIGHT.items():
        weight = F.when(F.col("source") == name, worth).otherwise(weight)
    text = F.col("source") == "text_based"
    counted = mentions.where("length(replace(key, ' ', '')) >= 3").distinct().withColumn("weight", weight).groupBy("paper_id", "key").agg(
        F.count("*").alias("n_mentions"), F.count_if(text).alias("n_text"), F.count_if(text & F.col("role").isin(PRIORITY_ROLES)).alias("n_priority_text"), F.count_if(~text).alias("n_table"),
        F.count_if(F.col("source") == "table_caption").alias("n_caption"), F.countDistinct("source").alias("n_sources"), F.bool_or(F.col("source") == "table_variable_name").alias("is_named"), F.max("weight").alias("top"),
    )
    priority = F.col("n_priority_text") > 0
    kept = counted.where(priority | F.col("is_named") | (F.col("n_sources") >= 2) | ((F.col("n_text") > 0) & (F.col("n_table") > 0)))
    basis = F.when(priority & F.col("is_named"), "priority_text_plus_variable_name").when(priority, "priority_text_support").when(F.col("is_named"), "deterministic_variable_name").otherwise("multi_source_agreement")
    score = F.least(F.lit(1.0), F.col("top") + 0.04 * (F.col("n_mentions") - 1))
    confidence = F.least(F.lit(0.99), 0.38 + 0.1 * F.col("n_priority_text") + 0.06 * F.col("n_text") + 0.04 * F.col("n_table") + 0.1 * F.col("top"))
    return kept.select("paper_id", F.col("key").alias("label"), "n_mentions", "n_text", "n_priority_text", "n_table", "n_caption", basis.alias("promotion_basis"), F.round(score, 4).alias("priority_score"), F.round(confidence, 4).alias("confidence"))


def duplicate_regions(tables: DataFrame, cells: DataFrame, least: float = 0.8) -> DataFrame:
    """(table_id, kept_id): tables of one page with the same cells of which one covers the other by ``least``; the smallest box is kept.

    Only tables with equal contents are ever compared. Of boxes of one size the smallest id is kept; tables without a
    box or a page are no duplicates.
    """
    from tabloom.operators.geometry import overlap_share

    box = F.col("positioned_evidence.canonical_bbox")
    content = cells.groupBy("table_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("row_idx", "col_idx", "clean")))), 256).alias("content"))
    one = tables.where(box.isNotNull() & F.col("page_num").isNotNull()).groupBy("paper_id", "page_num", "table_id").agg(F.min_by(box, "loaded_at").alias("box")).join(content, "table_id")
    one = one.withColumn("size", (F.col("box.x1") - F.col("box.x0")) * (F.col("box.y1") - F.col("box.y0")))
    other = one.select("paper_id", "page_num", "content", F.col("table_id").alias("kept_id"), F.col("box").alias("kept_box"), F.col("size").alias("kept_size"))
    better = F.struct("kept_size", "kept_id") < F.struct("size", "table_id")
    pairs = one.join(other, ["paper_id", "page_num", "content"]).where((F.col("kept_id") != F.col("table_id")) & better)
    shares = F.greatest(overlap_share(F.col("box"), F.col("kept_box")), overlap_share(F.col("kept_box"), F.col("box")))
    return pairs.where(shares >= least).groupBy("table_id").agg(F.min_by("kept_id", F.struct("kept_size", "kept_id")).alias("kept_id"))


def row_coverage_audit(rows: DataFrame, starts: DataFrame, variables: DataFrame, levels: DataFrame) -> DataFrame:
    """(table_id, status, n_rows): body rows against defined rows: both, row_only or definition_only."""
    body = rows.join(starts.select("table_id", "body_start"), "table_id").where("row_idx >= body_start").select("table_id", "row_idx", F.lit(True).alias("printed"))
    defined = variables.select("table_id", F.col("row_start").alias("row_idx")).unionByName(levels.select("table_id", "row_idx")).distinct().withColumn("defined", F.lit(True))
    both = body.join(defined, ["table_id", "row_idx"], "full")
    status = F.when(F.col("printed") & F.col("defined"), "both").when(F.col("printed"), "row_only").otherwise("definition_only")
    return both.groupBy("table_id", status.alias("status")).agg(F.count("*").alias("n_rows"))
