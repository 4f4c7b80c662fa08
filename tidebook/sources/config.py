"""Options of a capture or study, from the environment with a prefix; comments at line ends are cut off."""

from __future__ import annotations

import dataclasses
import os
import re

PREFIX = "TIDEBOOK_"


def clean(text: str) -> str:
    """The value without a trailing comment (``#`` after a blank or tab) and outer blanks; a value that is a comment only is empty."""
    text = text.strip()
    return "" if text.startswith("#") else re.split(r"[ \t]#", text, maxsplit=1)[0].strip()


@dataclasses.dataclass(frozen=True)
class Config:
    symbol: str = "btcusdt"
    root: str = "data"
    tick: float = 0.1
    levels: int = 10
    flush_seconds: float = 5.0
    rotate_seconds: int = 3_600
    queue_records: int = 200_000
    snapshot_seconds: float = 1_800.0
    gap_cooldown_seconds: float = 5.0
    stale_seconds: float = 60.0
    metrics_seconds: float = 60.0
    subscription_seconds: float = 30.0
    backoff_first: float = 1.0
    backoff_most: float = 60.0
    recycle_hours: float = 20.0
    write_failures: int = 50
    window: int = 100
    horizon: int = 100
    folds: int = 5
    purge: int | None = None
    seed: int = 0
    streams: str = "depth,trades"

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Config:
        env = dict(os.environ) if env is None else env
        out = {}
        for field in dataclasses.fields(cls):
            raw = env.get(PREFIX + field.name.upper())
            if raw is not None and (value := clean(raw)) != "":
                kind = str(field.type)
                out[field.name] = int(value) if kind.startswith("int") else float(value) if kind == "float" else value
        return cls(**out)

    def stream_options(self) -> dict[str, str]:
        """Backpressure and flushing of a streaming write: records admitted to a batch, and seconds between batches.

        The queue of a capture is the source's backlog; a batch admits so much of it and the rest waits at the source.
        """
        return {"maxRecordsPerBatch": str(self.queue_records), "processingTime": f"{self.flush_seconds:g} seconds"}

    def spark_options(self) -> dict[str, str]:
        """As options of a session, for jobs that read them there."""
        return {f"spark.tidebook.{k}": str(v) for k, v in dataclasses.asdict(self).items() if v is not None}
