"""Secret scans with an incremental ledger of blobs.

A text version is a blob, addressed by the SHA-256 of its UTF-8 bytes. The ledger is a folder of Parquet files with a row for
each scanned pair of blob and rule version: (blob, rule_version, spans). A run scans pairs that the ledger does not have,
each once however many rows hold the blob, appends them, and joins the findings to all rows. Only hashes are shuffled to
find the unseen blobs; a text moves once, to the one row that stands for its blob.

Null texts are empty. Spans are code points, end exclusive. Rows keep their number: repeated rows get a row each.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlens.llm.common import documents, map_batches, new_folder, record_batch

_SPANS = "array<struct<first: long, rank: int, kind: string, end: long>>"
_ENTRY = f"blob binary, rule_version string, spans {_SPANS}"


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``pattern`` that do not overlap, if group ``group`` has ``least`` characters or more.

    ``cues``: lower-case strings of which a text with a match has at least one, whatever its case.
    """

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    ignore_case: bool = False
    cues: tuple[str, ...] = ()

    def finder(self) -> Callable[[str, str], list[tuple[int, int]]]:
        find = re.compile(self.pattern, re.A | (re.I if self.ignore_case else 0)).finditer

        def spans(text: str, lower: str) -> list[tuple[int, int]]:
            if self.cues and not any(cue in lower for cue in self.cues):
                return []
            return [m.span() for m in find(text) if len(m[self.group]) >= self.least]

        return spans


#: Listed order is the order of findings that begin at the same place.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         least=8, group=2, ignore_case=True, cues=("passw", "secret", "token", "api")),
    Rule("access", r"AKIA[A-Z0-9]+", least=16, cues=("akia",)),
    Rule("hex", r"[0-9a-f]{32,}"),  # whole runs, as no shorter start of a run matches
)
MORE = (
    Rule("key_block", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", cues=("private key",)),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", cues=("eyj",)),
    Rule("host_token", r"gh[pousr]_[A-Za-z0-9]{36,}", cues=("gh",)),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/:@]+@", cues=("://",)),
)
RULES = (*BASE, *MORE)
RULE_VERSION = "rules-3"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _scan(rules: tuple[Rule, ...], version: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [(rank, rule.kind, rule.finder()) for rank, rule in enumerate(rules)]
        kind = pa.list_(pa.struct([("first", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()),
                                   ("end", pa.int64())]))
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                lower = (text or "").lower()
                spans = sorted((a, rank, name, b) for rank, name, find in finders for a, b in find(text or "", lower))
                found.append([dict(zip(("first", "rank", "kind", "end"), s)) for s in spans])
            yield record_batch(blob=batch.column(0), rule_version=pa.array([version] * batch.num_rows, pa.string()),
                               spans=pa.array(found, kind))
    return scan


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """(blob, rule_version, spans); empty where nothing has been scanned yet."""
    try:
        return spark.read.schema(_ENTRY).parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], _ENTRY)


def scan(docs: DataFrame, folder: str | None = None, rules: tuple[Rule, ...] = RULES,
         version: str = RULE_VERSION) -> DataFrame:
    """(doc_id, blob, spans) of every row, after scanning the blobs that the ledger in ``folder`` lacks."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "secret-ledger")
    rows = documents(docs).select("doc_id", blob_of(F.col("text")).alias("blob"), "text")
    known = read_ledger(spark, folder).where(F.col("rule_version") == version).select("blob")
    unseen = (rows.select("doc_id", "blob").groupBy("blob").agg(F.min("doc_id").alias("path"))
              .join(known, "blob", "left_anti").select(F.col("blob").alias("b"), "path"))
    one_row = rows.join(unseen, (F.col("blob") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("path")), "left_semi")
    map_batches(one_row.select("blob", "text"), _scan(rules, version), _ENTRY).write.mode("append").parquet(folder)
    entries = read_ledger(spark, folder).where(F.col("rule_version") == version)
    findings = entries.groupBy("blob").agg(F.first("spans").alias("spans"))  # rows repeated with id and text: scanned each
    return rows.select("doc_id", "blob").join(findings, "blob")


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["first"].cast("string"), s["end"].cast("string"))), ",")
