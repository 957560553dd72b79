"""A sort by seq whose memory doesn't follow the number of rows."""
from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc


class SeqSorter:
    """Tables in, record batches in seq order out. Beyond ROWS rows, sorted runs go to the executor's local disk and are merged from there, STEP rows of each at a time."""

    ROWS, STEP = 200_000, 4096

    def __init__(self) -> None:
        self.held: list[pa.Table] = []
        self.rows = 0
        self.folder: tempfile.TemporaryDirectory | None = None
        self.paths: list[str] = []

    def add(self, t: pa.Table) -> None:
        self.held.append(t)
        self.rows += len(t)
        if self.rows >= self.ROWS:
            self._spill()

    def _sorted(self) -> pa.Table:
        t, self.held, self.rows = pa.concat_tables(self.held).sort_by("seq").combine_chunks(), [], 0
        return t

    def _spill(self) -> None:
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="temploom-", dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        t = self._sorted()
        self.paths.append(f"{self.folder.name}/{len(self.paths)}")
        with pa.OSFile(self.paths[-1], "wb") as f, pa.ipc.new_stream(f, t.schema) as w:
            w.write_table(t, self.STEP)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if not self.paths:
            if self.held:
                yield from self._sorted().to_batches(10_000)
            return
        if self.held:
            self._spill()
        files = [pa.OSFile(p) for p in self.paths]
        try:
            runs = [pa.ipc.open_stream(f) for f in files]
            heads = [next(r) for r in runs]
            while heads:
                # Up to the least of the last seqs in hand no run has rows to come.
                bound = min(h.column("seq")[-1].as_py() for h in heads)
                cuts = [pc.sum(pc.less_equal(h.column("seq"), bound)).as_py() or 0 for h in heads]
                ready = pa.Table.from_batches([h.slice(0, k) for h, k in zip(heads, cuts) if k]).sort_by("seq")
                yield from ready.combine_chunks().to_batches(10_000)
                heads = [h.slice(k) if k < len(h) else next(r, None) for h, k, r in zip(heads, cuts, runs)]
                runs, heads = [r for r, h in zip(runs, heads) if h is not None], [h for h in heads if h is not None]
        finally:
            for f in files:
                f.close()
            self.folder.cleanup()
