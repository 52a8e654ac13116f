"""The model boundary: prompts in, texts out, one table each; recorded answers make it repeatable offline."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ModelProvider(Protocol):
    """Adds a column ``answer`` to a table with a column ``prompt``."""

    def ask(self, prompts: DataFrame) -> DataFrame: ...


class ReplayProvider:
    """Answers from a table (prompt_hash, answer); a prompt without one has a null answer."""

    def __init__(self, recorded: DataFrame):
        self.recorded = recorded.select("prompt_hash", "answer").dropDuplicates(["prompt_hash"])

    def ask(self, prompts: DataFrame) -> DataFrame:
        keyed = prompts.withColumn("prompt_hash", F.sha2("prompt", 256))
        return keyed.join(self.recorded, "prompt_hash", "left").drop("prompt_hash")


class EchoProvider:
    """The prompt is the answer."""

    def ask(self, prompts: DataFrame) -> DataFrame:
        return prompts.withColumn("answer", F.col("prompt"))


class CallProvider:
    """A function called once per prompt inside tasks, again on failure; after the last try the answer is null."""

    def __init__(self, call: Callable[[str], str], tries: int = 6):
        self.call, self.tries = call, tries

    def ask(self, prompts: DataFrame) -> DataFrame:
        call, tries = self.call, self.tries

        def one(prompt: str) -> str | None:
            for _ in range(tries):
                try:
                    return call(prompt)
                except (OSError, TimeoutError):
                    continue
            return None

        def answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(answer=batch["prompt"].map(one))

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema) + ", answer string"
        return prompts.mapInPandas(answers, schema)
