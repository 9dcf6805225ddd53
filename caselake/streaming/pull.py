"""Files pulled from a folder in rounds, landed, and then dealt with as their source asks.

A round takes the files that are due, in (time, name) order and at most ``max_files`` of them, lands their lines, does with
the files what the posture says, and only then is done. What a round chose is written down before anything is read,
so a round that stopped anywhere is run again over the same files: its landing is recognised by its id, files that
are already away are left alone, and no line lands twice or is lost. Listing and reading are Spark's; the driver
holds the names of one round.
"""

from __future__ import annotations

from collections.abc import Callable

from caselake.sources.bronze import Bronze, Landing
from caselake.sources.envelopes import POSTURES, due_files, file_lines, listing
from caselake.sources.files_meta import Markers


class Pull:
    def __init__(self, bronze: Bronze, source_id: str, directory: str, posture: str, archive_dir: str | None = None, glob: str = "*",
                 max_files: int = 1000, skip_header_lines: int = 0, encoding: str = "UTF-8"):
        if posture not in POSTURES:
            raise ValueError(f"after-download is required and one of {POSTURES}, found {posture!r}")
        if posture == "archive" and not archive_dir:
            raise ValueError("archiving needs a folder to archive into")
        self.bronze, self.source_id, self.directory, self.posture = bronze, source_id, directory.rstrip("/"), posture
        self.archive_dir, self.glob, self.max_files = archive_dir, glob, max_files
        self.skip_header_lines, self.encoding = skip_header_lines, encoding
        self.rounds = Markers(bronze.spark, f"{bronze.root}/pulls/{source_id}")
        self.files = Markers(bronze.spark, self.directory)

    def _last(self, kind: str) -> int:
        return max([int(n.split(".")[0]) for n in self.rounds.names() if n.endswith(f".{kind}.json")], default=0)

    def mark(self) -> str | None:
        """How far the source was read, once that was committed; only the watermark posture remembers it."""
        n = self._last("done")
        return self.rounds.read_json(f"{n:012d}.done.json")["mark"] if n and self.posture == "watermark" else None

    def _choose(self, n: int, after: str | None) -> dict | None:
        if self.files.is_empty():
            return None
        due = due_files(listing(self.bronze.spark, self.directory, self.glob), after, self.max_files) \
            .select("name", "path", "watermark").collect()
        if not due:
            return None
        chosen = {"names": [r["name"] for r in due], "paths": [r["path"] for r in due], "mark": due[-1]["watermark"]}
        self.rounds.create_json(f"{n:012d}.chosen.json", chosen)
        return chosen

    def _put_away(self, chosen: dict) -> None:
        for name in chosen["names"]:
            if self.posture == "archive":
                self.files.move(name, self.archive_dir)
            elif self.posture == "delete":
                self.files.remove(name)

    def round(self, after: str | None = None, between: Callable[[Landing], None] | None = None) -> tuple[Landing, str] | None:
        """One round: what it landed and its mark; nothing if no file is due. ``between`` is called before files are put away."""
        n = self._last("done") + 1
        name = f"{n:012d}.chosen.json"
        chosen = self.rounds.read_json(name) if self.rounds.exists(name) else self._choose(n, after if after is not None else self.mark())
        if chosen is None:
            return None
        landing_id = f"pull-{n:012d}"
        landed = self.bronze.committed(self.source_id, landing_id)
        if landed is None:     # the files are all there: none is put away before this is committed
            lines = file_lines(self.bronze.spark, chosen["paths"], self.source_id, skip_header_lines=self.skip_header_lines, encoding=self.encoding)
            landed = self.bronze.land(lines, self.source_id, landing_id)
        if between is not None:
            between(landed)
        self._put_away(chosen)
        self.rounds.create_json(f"{n:012d}.done.json", {"mark": chosen["mark"], "records": landed.records, "files": len(chosen["names"])})
        return landed, chosen["mark"]

    def drain(self, between: Callable[[Landing], None] | None = None) -> list[Landing]:
        """Rounds until no file is due. Without a posture that changes anything, the next drain finds all files again."""
        out, after = [], None
        while (done := self.round(after, between)) is not None:
            out.append(done[0])
            after = done[1] if self.posture in ("watermark", "none") else None
        return out
