"""The extraction stage: a user-supplied function over batches of documents."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

# a batch of texts -> a response object per text, or the error message of one that failed
Extractor = Callable[[pd.Series], list]


def extract_documents(documents: DataFrame, extractor: Extractor) -> DataFrame:
    """(path, parsed) -> (path, extracted): one JSON envelope per document.

    The extractor sees a batch at a time, as a remote model would. A document it rejects
    gets its error message and a null response; a null text is read as empty.
    """

    def envelope(found: dict | str) -> str:
        failed = isinstance(found, str)
        result = {"error_message": found if failed else None, "response": None if failed else found}
        return json.dumps(result, ensure_ascii=False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = extractor(batch["parsed"].fillna("").reset_index(drop=True))
            yield pd.DataFrame({"path": batch["path"], "extracted": [envelope(f) for f in found]})

    return documents.select("path", "parsed").mapInPandas(run, "path STRING, extracted STRING")
