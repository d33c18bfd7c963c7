"""Evidence blocks, prompts and report bundles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import shorten

NO_EVIDENCE = "No evidence found."
INSTRUCTIONS = "Answer from the evidence below only. Say what is required in plain words, cite the code section of each requirement in brackets, and name what still has to be confirmed."


def evidence_blocks(hits: DataFrame, label: str = "label", rank: str = "rank") -> DataFrame:
    """``label, block``: each label's hits as ``[citation] heading`` and a shortened text, blank lines between them."""
    cited = F.coalesce(F.nullif("full_citation", F.lit("")), F.col("chunk_id"))
    piece = F.concat(F.lit("["), cited, F.lit("] "), F.coalesce("section_heading", F.lit("")), F.lit("\n"), shorten(F.col("text")))
    rows = hits.select(label, F.col(rank).alias("_r"), piece.alias("_p"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "_p"))), lambda x: x["_p"]), "\n\n")
    return rows.groupBy(label).agg(F.concat(F.upper(F.col(label)), F.lit(":\n"), joined).alias("block"))


def prompts(facts: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """``key, prompt`` per request: instructions, facts as JSON, and its evidence blocks in the order of their labels."""
    evidence = blocks.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("label", "block"))), lambda x: x["block"]), "\n\n").alias("_evidence"))
    row = F.to_json(F.struct(*(F.col(c) for c in facts.columns if c != key)), {"ignoreNullFields": "false", "pretty": "true"})
    text = F.concat(F.lit(INSTRUCTIONS + "\n\nProperty context:\n"), row, F.lit("\n\nMunicipal code evidence:\n"), F.coalesce("_evidence", F.lit(NO_EVIDENCE)))
    return facts.join(evidence, key, "left").select(key, text.alias("prompt"))


def complete(prompts: DataFrame, key: str, completion: Callable[[str], str]) -> DataFrame:
    """``key, prompt, report, status`` from any completion function; an empty answer or an error is a status, not a failure."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            reports, states = [], []
            for p in f["prompt"]:
                try:
                    answer = (completion(p) or "").strip()
                    reports.append(answer or None)
                    states.append("ok" if answer else "empty")
                except Exception as e:  # noqa: BLE001  the caller's function may raise anything
                    reports.append(None)
                    states.append(f"error: {e}")
            yield f.assign(report=reports, status=states)

    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(key, "prompt").mapInPandas(run, f"{key} {kind}, prompt string, report string, status string")
