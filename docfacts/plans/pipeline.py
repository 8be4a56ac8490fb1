"""The two paths end to end, with the stages that are used more than once written to the shared folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from docfacts.functions.tables import durable
from docfacts.operators import guide, merge, model, normalize, rules, scanners, segment


@dataclass(frozen=True)
class Extraction:
    """Stages of the text path: documents, blocks, candidates, replies, packages, and the header's facts."""

    docs: DataFrame
    blocks: DataFrame
    candidates: DataFrame
    replies: DataFrame
    packages: DataFrame
    info: DataFrame

    def validate(self) -> tuple[DataFrame, DataFrame]:
        """(flags, metrics)."""
        return rules.validate(self.docs, self.packages, self.info)


def extract(raw: DataFrame, replies: DataFrame | None = None, anchor: str = normalize.PAGE_ANCHOR, heading: str = segment.PACKAGE_HEADING, docs: DataFrame | None = None, blocks: DataFrame | None = None) -> Extraction:
    """Text path over (doc_id, raw). replies: (doc_id, block_id, attempt, reply) of a model; without it the offline rules read the blocks.

    docs and blocks: these stages, where they are written already."""
    docs = durable(normalize.normalize(raw, anchor=anchor)) if docs is None else docs
    blocks = durable(segment.blocks(docs, heading)) if blocks is None else blocks
    candidates = scanners.scan_packages(blocks)
    settled = model.stub_replies(blocks) if replies is None else model.settle(blocks, model.parse_replies(replies))
    packages = durable(merge.merge(docs, blocks, candidates, settled))
    return Extraction(docs, blocks, candidates, settled, packages, merge.document_info(docs, scanners.scan_header(blocks)))


@dataclass(frozen=True)
class Guides:
    """Stages of the guide path: raw rows, benefit rows, one summary for each document, flags, and the exported table."""

    raw_rows: DataFrame
    rows: DataFrame
    summaries: DataFrame
    flags: DataFrame
    table: DataFrame


def read_guides(raw_rows: DataFrame, page_text: DataFrame | None = None, names: DataFrame | None = None, use_model: bool = True, missing: str = "-") -> Guides:
    """Guide path over the raw rows of any reader (see operators.readers)."""
    raw_rows = durable(raw_rows)
    rows = durable(guide.guide(raw_rows, page_text, names, use_model))
    summaries = guide.summaries(raw_rows, rows)
    return Guides(raw_rows, rows, summaries, guide.checks(rows, summaries), guide.csv_table(rows, missing))
