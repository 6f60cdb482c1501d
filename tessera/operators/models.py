"""Model calls as columns: a client factory per Python worker, batches of Arrow size, a fallback per item.

Without a model the deterministic stand-ins below fill every role, so plans are the same and results reproducible.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as tx

Client = Callable[[list[str]], list[str]]


def call_batch(client: Client, prompts: list[str], retries: int = 0) -> list[str | None]:
    """One call for all prompts; if that fails, one by one, and null where even that fails."""
    try:
        out = client(prompts)
        if len(out) == len(prompts):
            return list(out)
    except Exception:  # noqa: BLE001, S110
        pass
    found: list[str | None] = []
    for p in prompts:
        try:
            found.append(client([p])[0])
        except Exception:  # noqa: BLE001
            found.append(None)
    return found


def generate(factory: Callable[[], Client]) -> Callable[[Column], Column]:
    """A column function of prompts; the client is made once per task. Not deterministic, so Spark never repeats it freely."""

    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = factory()
        for prompts in it:
            yield pd.Series(call_batch(client, prompts.tolist()), dtype=object)

    run.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string").asNondeterministic()


def embed(factory: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[Column], Column]:
    """A column function of texts to vectors, batch by batch."""

    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in it:
            yield pd.Series([list(map(float, v)) for v in model(texts.fillna("").tolist())], dtype=object)

    run.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")


def hashed_embedding(text: Column | str, dim: int = 64) -> Column:
    """The stand-in embedder: token counts in hashed places, unit length."""
    import zlib

    import numpy as np

    # all other bytes are spaces, so words are split off without a pattern
    table = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))

    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            out = []
            for t in texts:
                words = (t or "").lower().encode("utf-8", "replace").translate(table).split()
                places = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % dim
                v = np.bincount(places, minlength=dim).astype(np.float32)
                size = float(np.linalg.norm(v))
                out.append(v / size if size else v)
            yield pd.Series(out)

    run.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")(F.col(text) if isinstance(text, str) else text)


def extractive_answer(client_prompts: list[str]) -> list[str]:
    """The stand-in generator: the first evidence block's first sentence, cited; INSUFFICIENT without evidence."""
    out = []
    for p in client_prompts:
        m = re.search(r"\[1\][^\n]*\n(.+)", p)
        said = re.split(r"(?<=[.!?])\s+", m[1].strip())[0].rstrip(".!?") if m else ""
        out.append(f"{said} [1]." if said else "INSUFFICIENT")
    return out


def overlap_judge(client_prompts: list[str]) -> list[str]:
    """The stand-in judge: ten times the share of the question's words that stand in the rest of the prompt."""
    out = []
    for p in client_prompts:
        m = re.search(r"Question: (.*)", p)
        asked = set(re.findall(r"[a-z0-9]+", (m[1] if m else "").lower()))
        rest = set(re.findall(r"[a-z0-9]+", p.replace(m[0], "").lower())) if m else set()
        out.append(f"{10 * len(asked & rest) / max(1, len(asked)):.2f}")
    return out


def reversed_reply(prompt: Column) -> Column:
    """The stand-in writer of hypothetical answers: the prompt's last paragraph backwards."""
    return F.reverse(F.element_at(F.split(prompt, "\n\n"), -1))


def literal_judge(prompt: Column) -> Column:
    """The stand-in judge of answers: claims are sentences, supported if the context has them; relevant is what shares a term."""
    after = lambda mark: F.substring_index(prompt, mark, -1)
    claims = F.to_json(tx.split_sentences(F.substring(prompt, F.instr(prompt, "\n\n") + 2, F.length(prompt))))
    claim = after("\n\nClaim: ")
    held = F.contains(F.substring(prompt, F.lit(1), F.length(prompt) - F.length(claim)), claim)
    asked = F.substring_index(F.substring_index(prompt, "\n\nAnswer: ", 1), "Question: ", -1)
    relevant = F.arrays_overlap(tx.terms(asked), tx.terms(after("\n\nAnswer: ")))
    return F.when(prompt.startswith("List the claims"), claims).when(prompt.startswith("Is the claim"), F.when(held, "SUPPORTED").otherwise("UNSUPPORTED")).otherwise(F.when(relevant, "YES").otherwise("NO"))


def healthy(factory: Callable[[], Client]) -> bool:
    try:
        return bool(factory()(["ping"]))
    except Exception:  # noqa: BLE001
        return False
