"""Labelling pairs by an agent: a model that may use tools for some turns before it decides, with traces, back-off and resumption.

Pairs are a table; each partition keeps at most `at_once` conversations going, so a server sees partitions x at_once requests. A request that fails is
sent again after a pause that doubles each time, with a part by hash of pair and try, so that clients don't come back together. Labels are
appended to a table in slices; a run that was broken off goes on with the pairs that are not in it, and asks for no pair of it again. A pair whose
requests all fail gets no label, keeps its trace, and is open for the next run.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.providers import HttpModel, reply_object
from quernstone.sources.datasets import exists

Tool = Callable[[dict, dict], object]
LABELS = "label int, confidence string, turns int, trace array<struct<turn:int,role:string,content:string>>"
SYSTEM = 'Decide whether two records describe one thing. Answer with one JSON object: {"tool": name, "args": {...}} to use a tool, or {"label": 0 or 1, "confidence": "high", "medium" or "low"}. Tools: '


class ChatModel:
    """A model server with /api/chat, as local model runners have. Instances travel to executors."""

    def __init__(self, host: str = "http://localhost:11434", model: str = "", timeout: float = 300.0):
        self.server = HttpModel(host, model, timeout=timeout)

    def __call__(self, messages: list[dict]) -> str:
        return self.server.post("/api/chat", {"model": self.server.model, "messages": messages, "stream": False})["message"]["content"]


def shared_words(row: dict, args: dict) -> dict:
    """Words of both texts, and their share."""
    a, b = (set(str(row.get(c) or "").lower().split()) for c in ("text_a", "text_b"))
    return {"shared": sorted(a & b), "share": round(len(a & b) / max(len(a | b), 1), 3)}


def numbers(row: dict, args: dict) -> dict:
    """Numbers in each text."""
    import re

    return {c: re.findall(r"\d+(?:[.,]\d+)?", str(row.get(c) or "")) for c in ("text_a", "text_b")}


TOOLS: dict[str, Tool] = {"shared_words": shared_words, "numbers": numbers}


def pause(key: str, k: int, first: float) -> float:
    """Seconds before the k-th repetition: doubling, and up to half of it more by hash."""
    part = int.from_bytes(hashlib.blake2b(f"{key}|{k}".encode(), digest_size=4).digest(), "little") / (1 << 32)
    return first * 2**k * (1 + part / 2)


def conversation(row: dict, chat: Callable[[list[dict]], str], tools: dict[str, Tool], most_turns: int, tries: int, first_pause: float) -> tuple:
    """(label, confidence, turns, trace) of one pair. Without an answer in most_turns, or after `tries` failures of one request, the label is null."""
    key = json.dumps(row, sort_keys=True, default=str)
    told = [{"role": "system", "content": SYSTEM + ", ".join(tools)}, {"role": "user", "content": key}]
    trace = [(0, m["role"], m["content"]) for m in told]
    for turn in range(1, most_turns + 1):
        for k in range(tries):
            try:
                reply = chat(told)
                break
            except (OSError, ValueError) as e:
                trace.append((turn, "error", str(e)))
                if k + 1 == tries:
                    return None, None, turn, trace
                time.sleep(pause(key, k, first_pause))
        told.append({"role": "assistant", "content": reply})
        trace.append((turn, "assistant", reply))
        said = reply_object(lambda _: reply, "", 0)  # noqa: B023
        if said.get("label") in (0, 1):
            sure = said.get("confidence")
            return int(said["label"]), sure if sure in ("high", "medium", "low") else "low", turn, trace
        if said.get("tool") in tools:
            try:
                answer = json.dumps(tools[said["tool"]](row, said.get("args") or {}), default=str)
            except Exception as e:  # a tool's failure is told to the model
                answer = json.dumps({"error": str(e)})
        else:
            answer = json.dumps({"error": "neither a label nor a tool that there is"})
        told.append({"role": "user", "content": answer})
        trace.append((turn, "tool", answer))
    return None, None, most_turns, trace


def asked(pairs: DataFrame, keys: list[str], chat: Callable[[list[dict]], str], tools: dict[str, Tool] | None = None, most_turns: int = 4, tries: int = 4, first_pause: float = 0.5, at_once: int = 4) -> DataFrame:
    """(keys, label, confidence, turns, trace) of pairs (keys, text_a, text_b, ...)."""
    tools = TOOLS if tools is None else tools
    types = dict(pairs.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                rows = b.to_dict("records")
                found = list(pool.map(lambda r: conversation(r, chat, tools, most_turns, tries, first_pause), rows))
                out = {k: b[k] for k in keys}
                labels = pd.array([f[0] for f in found], dtype="Int32")
                yield pd.DataFrame(out | {"label": labels, "confidence": [f[1] for f in found], "turns": [f[2] for f in found], "trace": [[{"turn": t, "role": r, "content": c} for t, r, c in f[3]] for f in found]})

    return pairs.mapInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", " + LABELS)


def label_all(pairs: DataFrame, keys: list[str], path: str, chat: Callable[[list[dict]], str], slices: int = 8, **more) -> DataFrame:
    """Labels what is not in path yet, slice by slice; gives the table of all labels. Traces of pairs without a label go to path + "-open".

    A slice's replies are written to path + "-now" before they are sorted into the two, and what a broken run left there is sorted in first.
    """
    spark, now = pairs.sparkSession, f"{path}-now"

    def unlabelled(rows: DataFrame) -> DataFrame:
        return rows.join(spark.read.parquet(path).select(*keys), keys, "left_anti") if exists(spark, path) else rows

    def sorted_in() -> None:
        done = spark.read.parquet(now)
        unlabelled(done.where("label is not null")).write.mode("append").parquet(path)
        done.where("label is null").write.mode("append").parquet(f"{path}-open")

    if exists(spark, now):
        sorted_in()
    for k in range(slices):
        todo = unlabelled(pairs.where(F.pmod(F.xxhash64(*keys), F.lit(slices)) == k).dropDuplicates(keys))
        asked(todo, keys, chat, **more).write.mode("overwrite").parquet(now)
        sorted_in()
    return spark.read.parquet(path)
