"""What a retrieved document, or the row of a question, says of itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sextant.functions.text import strip
from sextant.functions.values import optional_text

#: What ends a line, the kinds of questions over several documents,
#: and where they stand in a row's metadata.
LINE_ENDS = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"
KINDS = ("comparison", "bridge")
KIND, DOCUMENT_ID = "$.type", "$.document_id"


def title_of(*candidates: Column) -> Column:
    """First line of the first candidate that is not blank; empty if all are."""
    found = F.coalesce(*(optional_text(c) for c in candidates), F.lit(""))
    return strip(F.split(found, LINE_ENDS, 2)[0])


def _json_kind(document: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(document), path, "variant"))


def document_id(document: Column, required: bool) -> Column:
    """``id`` and ``valid`` of a document (JSON): an id is a text that is not blank
    or an integer.  It may be missing unless ``required``, but not be null."""
    kind, text = _json_kind(document, DOCUMENT_ID), F.get_json_object(document, DOCUMENT_ID)
    named = (kind == "STRING") & (F.length(strip(text)) > 0)
    whole = F.rlike(kind, F.lit("^(BIGINT|DECIMAL.*)$")) & F.rlike(text, F.lit("^-?[0-9]+$"))
    good = F.coalesce(named | whole, F.lit(False))
    there = F.startswith(_json_kind(document, "$"), F.lit("OBJECT"))
    missing = F.lit(False) if required else F.coalesce(there, F.lit(False)) & kind.isNull()
    return F.struct(F.when(good, text).alias("id"), (good | missing).alias("valid"))


def question_kind(metadata: Column) -> Column:
    """Kind of a question from its row's metadata (JSON); null if it is none of the
    known ones, or no text."""
    kind = F.get_json_object(metadata, KIND)
    return F.when(kind.isin(*KINDS), kind)


def contract_digest(document: Column) -> Column:
    """SHA-256 of a JSON document with sorted keys and without spaces, so that its
    layout does not count; null if it is no JSON."""
    return F.sha2(F.to_json(F.try_parse_json(document)), 256)
