"""Registry of the training-data queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import copies, lookalike, matching, mixing, names, scans, spans, tokenize
from quire.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of byte_bpe_50k of every document."""
    return tokenize.encode_corpus(table(spark, sf_dir, "documents"))


QUERIES["p7_ids"] = p7_ids


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, row_key, text) of the texts that problem 4 names."""
    spans = table(spark, sf_dir, "spans").select(F.lit("spans").alias("tbl"), F.concat_ws("/", "doc_id", "page", "line_no", "span_no").alias("row_key"), "text")
    bib = table(spark, sf_dir, "bib_entries").select(F.lit("bib_entries"), "entry_id", "title")
    records = table(spark, sf_dir, "records").select(F.lit("records"), "record_id", "title")
    return spans.union(bib).union(records)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text holds a character that is taken for another or not seen."""
    return lookalike.found(_titled(spark, sf_dir))


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of the three tables in its consistent form."""
    return lookalike.normalise(_titled(spark, sf_dir)).select("tbl", "row_key", "text", "form")


QUERIES |= {"p4_found": p4_found, "p4_forms": p4_forms}

_LOOK = "".join(sorted(lookalike.LOOKALIKES))
ORACLE["p4_found"] = (
    "SELECT DISTINCT tbl, row_key FROM ("
    "SELECT 'spans' AS tbl, concat_ws('/', doc_id, page, line_no, span_no) AS row_key, text FROM spans "
    "UNION ALL SELECT 'bib_entries', entry_id, title FROM bib_entries UNION ALL SELECT 'records', record_id, title FROM records) "
    r"WHERE regexp_matches(rtrim(text), '[\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}]|\x{00AD}.|[\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
    r"|[\x{FF01}-\x{FF5E}]|[\x{FB00}-\x{FB06}]|[\x{1D400}-\x{1D7FF}]|[\x{0300}-\x{036F}]') "
    rf"OR regexp_matches(text, '\p{{Latin}}[\p{{L}}\p{{M}}]*[{_LOOK}]|[{_LOOK}][\p{{L}}\p{{M}}]*\p{{Latin}}')"
)


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical rows of the two tables that problem 6 names."""
    papers = copies.canonical_rows(table(spark, sf_dir, "papers"), "papers", "id", ["title", "authors", "year", "venue", "pages", "doi", "url"], copies.canonical_publication)
    bib = copies.canonical_rows(table(spark, sf_dir, "bib_entries"), "bib_entries", "entry_id", ["raw"], copies.canonical_text)
    return papers.unionByName(bib)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest key of each set of copies with each other key."""
    return copies.pairs(_prints(spark, sf_dir))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each set of copies, with their number."""
    return copies.collapsed(_prints(spark, sf_dir))


QUERIES |= {"p6_found": p6_found, "p6_counts": p6_counts}


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with a verbatim stretch of 200 or more code points in common."""
    return spans.pairs(table(spark, sf_dir, "documents"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document stands in others too."""
    return spans.shares(table(spark, sf_dir, "documents"))


def p9_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of each document that stand in others too."""
    return spans.stretches(table(spark, sf_dir, "documents"))


QUERIES |= {"p9_found": p9_found, "p9_shares": p9_shares, "p9_stretches": p9_stretches}


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixes of mix_targets, document by document."""
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that each mix reaches."""
    return mixing.reached(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


QUERIES |= {"p8_mix": p8_mix, "p8_shares": p8_shares}


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations with the records of the work they cite."""
    return matching.match(table(spark, sf_dir, "bib_entries"), table(spark, sf_dir, "records")).select("entry_id", "record_id")


def p5_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations with the records of the work they cite, and how sure each match is."""
    return matching.match(table(spark, sf_dir, "bib_entries"), table(spark, sf_dir, "records"))


QUERIES |= {"p5_found": p5_found, "p5_confidence": p5_confidence}


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, n) of every author list."""
    parts = [names.listed(table(spark, sf_dir, t), "authors") for t in ("bib_entries", "records", "papers")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, h) of every author list beside a title."""
    parts = [names.titled(table(spark, sf_dir, t), "authors", "title") for t in ("bib_entries", "records", "papers")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two spellings of one person or organisation."""
    return names.pairs(_names(spark, sf_dir), _titles(spark, sf_dir))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spelling with the group it belongs to."""
    return names.groups(_names(spark, sf_dir), _titles(spark, sf_dir))


QUERIES |= {"p1_found": p1_found, "p1_groups": p1_groups}


def _repair(spark: SparkSession, sf_dir: str) -> scans.Repair:
    bib, records = table(spark, sf_dir, "bib_entries"), table(spark, sf_dir, "records")
    fields = scans.field_texts(bib, "authors", "venue").unionByName(scans.field_texts(records, "title", "authors", "venue"))
    return scans.Repair(table(spark, sf_dir, "spans"), table(spark, sf_dir, "page_lines"), bib, fields)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken and misread words with their right forms, running headers and page numbers."""
    return _repair(spark, sf_dir).found()


def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired texts as continuous paragraphs."""
    return _repair(spark, sf_dir).paragraphs()


QUERIES |= {"p2_found": p2_found, "p2_paragraphs": p2_paragraphs}
