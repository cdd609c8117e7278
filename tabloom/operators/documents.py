"""Documents of papers: lines, sections, table mentions, reference lists, page furniture and term search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.text import ENTITIES, SPACE, label_text
from tabloom.runtime import checkpoint

# What a section's heading may begin with or hold, in order of preference.
SECTION_HINTS = [
    ("abstract_like", ["abstract"]),
    ("methods_like", ["method", "materials and methods", "patients and methods", "study design", "study population", "measurement", "covariate", "exposure", "statistical analysis"]),
    ("results_like", ["result", "findings"]),
    ("discussion_like", ["discussion"]),
    ("conclusion_like", ["conclusion", "summary"]),
    ("references_like", ["reference", "bibliography", "works cited"]),
]
#: A numbered entry of a reference list.
ENTRY = r"^(?:\[ *([0-9]{1,3}) *\]|([0-9]{1,3})[.)]) +(\S.*)$"
#: Bits of a word run's place in the filter that runs pass before they are joined with terms, and the weight of a byte's place.
FILTER_BITS, _BASE = 18, 0x100000001B3
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[48:58], _FOLD[97:123], _FOLD[65:91] = np.arange(48, 58), np.arange(97, 123), np.arange(97, 123)


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, paper_id, line_no, line): every line of every text, blank ones too. Null texts give none."""
    return docs.select("doc_id", "paper_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def section_role(heading):
    """The role that a heading hints at, or other; null for no heading."""
    low = F.lower(heading)
    out = F.lit("other")
    for role, hints in reversed(SECTION_HINTS):
        test = low.contains(hints[0])
        for hint in hints[1:]:
            test = test | low.contains(hint)
        out = F.when(test, role).otherwise(out)
    return F.when(heading.isNull(), None).otherwise(out)


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, heading, role): the first line where it is short and ends no sentence, and its role."""
    first = F.trim(F.element_at(F.split("text", "\n"), 1))
    heading = F.when((F.length(first) <= 40) & first.rlike("^[A-Za-z][A-Za-z ]*$"), first)
    out = docs.where("text is not null").select("doc_id", heading.alias("heading"))
    return out.withColumn("role", section_role(F.col("heading")))


def table_mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, paper_id, line_no, number, kind): captions, continuations and prose mentions of tables by line."""
    found = lines(docs).where(F.col("line").rlike(r"\bTable +S?[0-9]+")).select("*", F.explode(F.regexp_extract_all("line", F.lit(r"\bTable +(S?[0-9]+)"), F.lit(1))).alias("number"))
    caption = F.col("line").rlike(r"^Table +S?[0-9]+\. ") & (F.regexp_extract("line", r"^Table +(S?[0-9]+)", 1) == F.col("number"))
    kind = F.when(caption & F.col("line").rlike(r"\(continued\) *$"), "continuation").when(caption, "caption").otherwise("prose")
    return found.select("doc_id", "paper_id", "line_no", "number", kind.alias("kind")).distinct()


def bibliography_entries(docs: DataFrame) -> DataFrame:
    """Numbered entries: doc_id, paper_id, line_no, number, n_lines, entry_text, and suffix, which counts a number's entries in its paper.

    An entry runs from a numbered line to the line before the next or to a blank line.
    """
    at = lines(docs).withColumn("starts", F.col("line").rlike(ENTRY)).withColumn("blank", F.trim("line") == "")
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    runs = at.withColumn("entry", F.sum(F.when(F.col("starts") | F.col("blank"), 1).otherwise(0)).over(w))
    whole = runs.where("not blank").groupBy("doc_id", "paper_id", "entry").agg(
        F.max("starts").alias("starts"), F.min("line_no").alias("line_no"), F.count("*").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("all")
    ).where("starts")
    number = F.coalesce(F.nullif(F.regexp_extract("all", ENTRY, 1), F.lit("")), F.nullif(F.regexp_extract("all", ENTRY, 2), F.lit(""))).try_cast("int")
    text = F.trim(F.regexp_replace(F.regexp_extract("all", ENTRY, 3), SPACE + "+", " "))
    out = whole.select("doc_id", "paper_id", "line_no", number.alias("number"), "n_lines", text.alias("entry_text")).where("number is not null")
    return out.withColumn("suffix", F.row_number().over(Window.partitionBy("paper_id", "number").orderBy("doc_id", "line_no")))


def bibliography_report(entries: DataFrame) -> DataFrame:
    """Per paper: entries, distinct numbers, least and greatest, how many between are missing, and long entries."""
    out = entries.groupBy("paper_id").agg(
        F.count("*").alias("n_entries"), F.countDistinct("number").alias("n_numbers"), F.min("number").alias("min_number"), F.max("number").alias("max_number"),
        F.count_if((F.col("n_lines") >= 12) | (F.length("entry_text") >= 1800)).alias("n_long"),
    )
    return out.withColumn("n_missing", F.col("max_number") - F.col("min_number") + 1 - F.col("n_numbers"))


def furniture(docs: DataFrame, least: int = 3) -> DataFrame:
    """(paper_id, template, n_docs, n_lines): lines that recur in ``least`` or more documents of a paper, numbers blanked."""
    template = F.regexp_replace(F.trim(F.regexp_replace("line", SPACE + "+", " ")), "[0-9]+", "<n>")
    shown = lines(docs).where("paper_id is not null").withColumn("template", template).where("template <> ''")
    return shown.groupBy("paper_id", "template").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_lines")).where(F.col("n_docs") >= least)


def unmasked_lines(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Lines per document once recurring ones are taken out by an anti join on their template."""
    template = F.regexp_replace(F.trim(F.regexp_replace("line", SPACE + "+", " ")), "[0-9]+", "<n>")
    own = lines(docs).withColumn("template", template)
    return own.join(marks.select("paper_id", "template"), ["paper_id", "template"], "left_anti").where("template <> ''").groupBy("doc_id").agg(F.count("*").alias("n_lines"))


def term_documents(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(paper_id, term, n_docs): documents of a term's own paper that hold it as whole words.

    Terms meet word sequences of the documents by equality, so no document is compared with every term.
    """
    known = terms.select("paper_id", F.lower(label_text(F.col("term"))).alias("term"))
    return term_hits(docs, known).groupBy("paper_id", "term").agg(F.countDistinct("doc_id").alias("n_docs"))


class WordHashes:
    """Words of texts in plain form, and the hash of any run of them: differences of a prefix sum of weighted bytes."""

    def __init__(self, texts: list[str]):
        for entity in ENTITIES:
            texts = [t.replace(entity, " ") if "&" in t else t for t in texts]
        encoded = [b" " + t.encode("utf-8", "replace") for t in texts]
        first = np.concatenate(([0], np.cumsum([len(e) for e in encoded]))).astype(np.int64)
        folded = _FOLD[np.frombuffer(b"".join(encoded), dtype=np.uint8)]
        blank = folded == 32
        kept = np.flatnonzero(~(blank & np.concatenate(([False], blank[:-1]))))
        self.buffer = np.append(folded[kept], np.uint8(32))
        space = self.buffer == 32
        self.starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        self.ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        self.doc = np.searchsorted(np.searchsorted(kept, first), self.starts, side="right") - 1
        powers, back = (np.cumprod(np.full(len(self.buffer), np.uint64(b), dtype=np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        self._sum = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((self.buffer.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)))
        self._back = back

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(doc, start, end, place in the filter) of every run of ``n`` words within one text."""
        last = max(len(self.starts) - n + 1, 0)
        whole = np.flatnonzero(self.doc[:last] == self.doc[n - 1 : n - 1 + last])
        a, b = self.starts[whole], self.ends[whole + n - 1]
        mixed = (self._sum[b] - self._sum[a]) * self._back[a] * np.uint64(0x9E3779B97F4A7C15)
        return self.doc[whole], a, b, (mixed >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def term_hits(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(paper_id, doc_id, term) of terms, as words, that a document of their paper holds, by equality of word sequences.

    Each text is scanned once for each length that terms have, all its word runs at a time; a run whose hash no term has
    is dropped there, by a bitmap of 2 ** FILTER_BITS bits whatever the number of terms, and the join decides. Texts stay
    in their tasks. Null texts and papers give no rows.
    """
    known = checkpoint(terms.where("length(term) >= 3 and paper_id is not null").select("paper_id", "term").distinct())

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("term").to_pylist()
            index = WordHashes(texts)
            size = np.bincount(index.doc, minlength=len(texts))
            for n in np.unique(size[size > 0]).tolist():
                doc, _, _, place = index.runs(n)
                place = np.unique(place[size[doc] == n])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), n), pa.int32()), pa.array(place, pa.int64())], names=["words", "place"])

    filtered = known.select("term").distinct().mapInArrow(places, "words int, place long").distinct().toPandas()  # at most 2 ** FILTER_BITS places a length
    filters = {int(n): np.unique(part.to_numpy()) for n, part in filtered.groupby("words")["place"]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = {}
        for n, place in filters.items():
            bitmaps[n] = np.zeros(1 << FILTER_BITS, dtype=bool)
            bitmaps[n][place] = True
        for batch in batches:
            index = WordHashes(batch.column("text").to_pylist())
            found: dict[tuple[int, bytes], None] = {}
            for n, bitmap in bitmaps.items():
                doc, a, b, place = index.runs(n)
                hit = np.flatnonzero(bitmap[place])
                for d, i, j in zip(doc[hit].tolist(), a[hit].tolist(), b[hit].tolist()):
                    found[d, index.buffer[i:j].tobytes()] = None
            at = pa.array([d for d, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("paper_id").take(at), pa.array([g.decode() for _, g in found], pa.string())], names=["doc_id", "paper_id", "term"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = docs.where("paper_id is not null and text is not null").select("doc_id", "paper_id", "text").mapInArrow(run, f"doc_id {kind}, paper_id string, term string")
    return spans.join(known, ["paper_id", "term"])
