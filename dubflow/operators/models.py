"""The boundary to models: batches in, one answer a row out, with a chain of backends and a last resort."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

#: Loads a model once a task; what it returns answers a batch of inputs.
Loader = Callable[[], Callable[[list], list]]


def _null(x) -> bool:
    return x is None or x is pd.NA or isinstance(x, float) and x != x


def predict(df: DataFrame, column: str, out: str, kind: str, backends: list[tuple[str, Loader]], last: Callable | None = None, size: int = 8) -> DataFrame:
    """df with `out` and `backend`: each batch of `size` rows is answered by the first backend that does so without an error.

    Where all fail, each row by itself is tried with each; what still fails gets last(input), or null, and backend null.
    A backend that can't be loaded is passed over. Null inputs go to no backend and get null.
    """

    def run(batches):
        ready = []
        for name, load in backends:
            try:
                ready.append((name, load()))
            except Exception:  # the next backend takes over
                continue

        def ask(inputs):
            for name, f in ready:
                try:
                    got = list(f(inputs))
                except Exception:
                    continue
                if len(got) == len(inputs):
                    return [(g, name) for g in got]
            if len(inputs) > 1:
                return [ask([x])[0] for x in inputs]
            return [(last(inputs[0]) if last else None, None)]

        for b in batches:
            answers = [(None, None)] * len(b)
            some = [i for i, x in enumerate(b[column]) if not _null(x)]
            for k in range(0, len(some), size):
                part = some[k : k + size]
                for i, a in zip(part, ask([b[column].iloc[i] for i in part])):
                    answers[i] = a
            yield b.assign(**{out: pd.Series([a[0] for a in answers], index=b.index, dtype=object), "backend": pd.Series([a[1] for a in answers], index=b.index, dtype=object)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{fields}, `{out}` {kind}, backend string")


def stub_translator(target: str) -> Loader:
    """Stands for a translation model: marks the text with its target."""
    return lambda: lambda texts: [f"[{target}] {t}" for t in texts]
