"""Extension hooks: commands of the user's that embed, route or propose. A command reads JSON on its standard input and answers in JSON;
one that fails or takes too long gives nothing, and retrieval stays lexical."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.session import ship


def ask(command: list[str], payload: dict, seconds: float) -> dict | None:
    try:
        done = subprocess.run(command, input=json.dumps(payload), capture_output=True, text=True, timeout=seconds, check=True)
        answer = json.loads(done.stdout)
    except (OSError, subprocess.SubprocessError, ValueError):
        return None
    return answer if isinstance(answer, dict) else None


def embedder(command: list[str], seconds: float = 10.0) -> Callable[[Column], Column]:
    """A vectorised function of texts to vectors; null where the command has no good answer for the batch."""
    if session := SparkSession.getActiveSession():
        ship(session)

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        answer = ask(command, {"texts": texts.fillna("").tolist()}, seconds) or {}
        vectors = answer.get("vectors")
        good = isinstance(vectors, list) and len(vectors) == len(texts) and len({len(v) for v in vectors if isinstance(v, list)}) <= 1
        return pd.Series(vectors if good else [None] * len(texts))

    return embed


def route(query: str, candidates: DataFrame, command: list[str], limit: int, seconds: float = 10.0) -> list[str]:
    """Ids in the command's order, of at most 256 candidates (claim_id, claim); none if it fails."""
    rows = candidates.select("claim_id", "claim").orderBy("claim_id").limit(256).collect()
    answer = ask(command, {"query": query, "candidates": [r.asDict() for r in rows]}, seconds) or {}
    known = {r.claim_id for r in rows}
    return list(dict.fromkeys(i for i in answer.get("ids", []) if i in known))[:limit]


class Deriver(Protocol):
    def propose(self, source: str, qualname: str) -> list[dict]: ...


class NameDeriver:
    """The default: says what the name says, supported by the name itself."""

    def propose(self, source: str, qualname: str) -> list[dict]:
        name = qualname.rsplit(".", 1)[-1]
        return [{"claim": f"{qualname} is defined here", "kind": "structure", "evidence_class": "source-verifiable", "support": [name], "confidence": 0.5}]


def candidates(functions: DataFrame, deriver: Deriver) -> DataFrame:
    """functions (claim_id, source, qualname): the first proposal for each, with whether its support stands in the source."""
    kind = "claim_id string, claim string, kind string, evidence_class string, support array<string>, confidence double, supported boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, source, name in zip(b.claim_id, b.source, b.qualname, strict=True):
                for c in deriver.propose(source or "", name)[:1]:
                    support = [str(s) for s in c.get("support", [])]
                    out.append((i, c["claim"], c.get("kind", "structure"), c.get("evidence_class", ""), support, float(c.get("confidence", 0.0)), bool(support) and all(s in (source or "") for s in support)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in kind.split(", ")])

    ship(functions.sparkSession)
    return functions.select("claim_id", "source", "qualname").mapInPandas(run, kind)
