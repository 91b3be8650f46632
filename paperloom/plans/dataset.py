"""The dataset contract: raw records from a file, then rows that a model trains on."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from paperloom.functions import literals, prompts
from paperloom.operators import models, sampling
from paperloom.sources import files

#: load() gives a tokenizer, a function from texts to lists of ids; it is called once a worker.
Tokenizer = Callable[[], Callable[[pd.Series], pd.Series]]


class Dataset(ABC):
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @abstractmethod
    def load_data(self) -> dict[str, DataFrame]:
        """The raw records of each part."""

    @abstractmethod
    def preprocess(self, tokenizer: Tokenizer, max_length: int) -> dict[str, DataFrame]:
        """The rows of each part, ready for a model."""


class ExamDataset(Dataset):
    """Exam records in CSV, in an exact train and test part."""

    def __init__(self, spark: SparkSession, path: str, share: float = 0.8, seed: int = 42, template: str = "base", on_error: str = "default"):
        super().__init__(spark, path)
        self.share, self.seed, self.template, self.on_error = share, seed, template, on_error

    def load_data(self) -> dict[str, DataFrame]:
        rows = sampling.train_test_split(files.read_csv(self.spark, self.path), "id", self.share, self.seed)
        return {part: rows.filter(rows["split"] == part).drop("split") for part in ("train", "test")}

    def preprocess(self, tokenizer: Tokenizer, max_length: int) -> dict[str, DataFrame]:
        """id, answer, input_ids and attention_mask; training rows end with their answer and are left out if they are too long, others are cut."""
        out = {}
        for part, rows in self.load_data().items():
            chats = prompts.chat_messages(literals.flattened(rows, self.on_error), self.template, with_answer=part == "train")
            out[part] = models.tokenized(chats, tokenizer, max_length, truncation=part != "train")
        return out
