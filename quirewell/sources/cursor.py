"""Pages that follow one another by a cursor, landed as files: a data source for tables and streams.

A folder holds ``chain=<name>/cursor=<value>/`` with one file of one JSON object:
``{"items": [...], "has_more": 0 or 1, "next": ...}``. A chain is what was asked
for (a shelf, a book); its first page has the cursor ``first``. With the option
``cursor`` = ``items`` the next page's cursor is the last item's ``sort``,
otherwise it is the page's own ``next``, which must move on.

Many pages may lie together in ``chain=<name>/pages=packed/``, in Parquet files
that don't change once they are there: a row for each page with ``cursor, has_more,
next, last`` (the last item's ``sort``) and ``items``, a list of JSON objects. To
follow such pages only the short columns are read, each file once.

Tasks read up to PAGES pages of a chain, or PACKED of one file. The offset of a
stream is the cursor that each chain goes on from, so a restarted query reads on
where it stopped. A stream takes all that has landed: Spark asks once where a
source ends when it runs one to its end, so an offset short of that would leave
the rest out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import groupby
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FIRST = "first"
#: Pages of a chain that one task reads, pages of a packed file, and packed pages in a batch of rows.
PAGES, PACKED, TOGETHER = 50, 2000, 50
SCHEMA = pa.schema({"chain": pa.string(), "cursor": pa.string(), "position": pa.int32(), "item": pa.string()})


def escaped(name: str) -> str:
    """A value as it stands in a partition's folder name."""
    return "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\{[]^\x7f" or c < " " else c for c in name)


class CursorError(ValueError):
    """A page says that there is more but not where, or names the cursor that led to it."""


@dataclass
class Pages(InputPartition):
    """Pages of a chain: those at ``cursors``, or the ``rows`` of a packed ``file``."""

    chain: str
    cursors: list[str]
    file: str = ""
    rows: list[int] = field(default_factory=list)


def batch(chain: str, cursors: pa.Array, items: pa.Array) -> pa.RecordBatch:
    """Rows of pages, given their cursors and lists of items."""
    counts = pc.fill_null(pc.list_value_length(items), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    page = np.repeat(np.arange(len(counts)), counts)
    position = np.arange(len(page)) - np.repeat(np.cumsum(counts) - counts, counts)
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(chain, pa.string()), len(page)), cursors.take(pa.array(page)), pa.array(position, pa.int32()), pc.list_flatten(items)], schema=SCHEMA)


class Folder:
    """The landed pages of a path."""

    def __init__(self, options: dict[str, str]) -> None:
        self.by_items = options.get("cursor", "next") == "items"
        self.uri = options["path"]
        self.fs, self.path = pafs.FileSystem.from_uri(self.uri if "://" in self.uri or self.uri.startswith("file:") else "file://" + self.uri)
        self.known: dict[str, tuple[set[str], dict[str, tuple]]] = {}  # by chain: packed files that were read, and what they say of their pages

    def chains(self) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(self.path, allow_not_found=True))
        return sorted(unquote(f.base_name[6:]) for f in found if f.base_name.startswith("chain="))

    def body(self, chain: str, cursor: str) -> dict | None:
        """The page at a cursor; None if it hasn't landed yet."""
        at = f"{self.path}/chain={escaped(chain)}/cursor={escaped(cursor)}"
        files = sorted(f.path for f in self.fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if f.is_file and not f.base_name.startswith(("_", ".")) and f.size)
        if not files:
            return None
        with self.fs.open_input_stream(files[0]) as f:
            return json.loads(f.read())

    def packed(self, chain: str) -> dict[str, tuple]:
        """``file, row, has_more, next, last`` of the chain's packed pages by their cursors; of pages with one cursor the first counts."""
        read, pages = self.known.setdefault(chain, (set(), {}))
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.path}/chain={escaped(chain)}/pages=packed", allow_not_found=True))
        for path in sorted(f.path for f in found if f.is_file and f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", "."))):
            if path not in read:
                with self.fs.open_input_file(path) as f:
                    head = pq.ParquetFile(f).read(columns=["cursor", "has_more", "next", "last"]).to_pydict()
                for row, (cursor, *said) in enumerate(zip(head["cursor"], head["has_more"], head["next"], head["last"], strict=True)):
                    pages.setdefault(cursor, (path, row, *said))
                read.add(path)
        return pages

    def after(self, chain: str, cursor: str, page: dict) -> str | None:
        """The cursor of the page that follows; None after the last one."""
        if page.get("has_more") != 1:
            return None
        following = (page["items"][-1].get("sort") if page.get("items") else None) if self.by_items else page.get("next")
        if following is None:
            raise CursorError(f"{chain}: the page at {cursor} has more, but no cursor")
        if str(following) == cursor:
            raise CursorError(f"{chain}: the cursor stands at {cursor}")
        return str(following)

    def walk(self, chain: str, cursor: str | None, until: str | None = None) -> tuple[list[str], str | None]:
        """The cursors of the landed pages from ``cursor`` on, before ``until``, and the one to go on from (None: the chain has ended)."""
        found: dict[str, None] = {}
        packed = self.packed(chain)
        while cursor is not None and cursor != until:
            if cursor in packed:
                _, _, more, following, last = packed[cursor]
                page = {"has_more": more, "next": following, "items": [{"sort": last}]}
            else:
                page = self.body(chain, cursor)
            if page is None:
                break
            if cursor in found:
                raise CursorError(f"{chain}: the cursor comes back to {cursor}")
            found[cursor] = None
            cursor = self.after(chain, cursor, page)
        return list(found), cursor

    def walk_all(self, begin: dict[str, str | None]) -> dict[str, tuple[list[str], str | None]]:
        """``walk`` for every chain, from its cursor in ``begin`` or its first; chains side by side, as each waits for its files."""
        chains = self.chains()
        with ThreadPoolExecutor(8) as pool:
            return dict(zip(chains, pool.map(lambda c: self.walk(c, begin.get(c, FIRST)), chains), strict=True))

    def dealt(self, walked: dict[str, list[str]]) -> list[Pages]:
        out = []
        for chain, cursors in walked.items():
            packed = self.known.get(chain, (None, {}))[1]
            for file, run in groupby(cursors, lambda c: packed[c][0] if c in packed else ""):  # noqa: B023
                run = list(run)
                size = PACKED if file else PAGES
                cut = [run[i : i + size] for i in range(0, len(run), size)]
                out += [Pages(chain, [], file, sorted(packed[c][1] for c in r)) if file else Pages(chain, r) for r in cut]
        return out or [Pages("", [])]

    def rows(self, pages: Pages) -> Iterator[pa.RecordBatch]:
        for cursor in pages.cursors:
            body = self.body(pages.chain, cursor) or {}
            items = [json.dumps(item, ensure_ascii=False) for item in body.get("items") or []]
            yield batch(pages.chain, pa.array([cursor], pa.string()), pa.array([items], pa.list_(pa.string())))
        if pages.file:
            with self.fs.open_input_file(pages.file) as f:
                yield from self._packed_rows(pages, pq.ParquetFile(f))

    def _packed_rows(self, pages: Pages, file: pq.ParquetFile) -> Iterator[pa.RecordBatch]:
        wanted, at = np.array(pages.rows), 0
        for group in range(file.num_row_groups):
            end = at + file.metadata.row_group(group).num_rows
            if not ((wanted >= at) & (wanted < end)).any():
                at = end
                continue
            for b in file.iter_batches(TOGETHER, [group], ["cursor", "last", "items"]):
                b, at = b.take(pa.array(wanted[(wanted >= at) & (wanted < at + len(b))] - at)), at + len(b)
                cursors, last, items = (b.column(c) for c in ("cursor", "last", "items"))
                if self.by_items:
                    self._agree(pages.chain, cursors, last, items)
                yield batch(pages.chain, cursors, items)

    def _agree(self, chain: str, cursors: pa.Array, last: pa.Array, items: pa.Array) -> None:
        """The chain was followed by what a file says is the last item's place; here are the items."""
        for cursor, said, page in zip(cursors, last, items, strict=True):
            end = json.loads(page[-1].as_py()).get("sort") if page.is_valid and len(page) else None
            if said.as_py() != (None if end is None else str(end)):
                raise CursorError(f"{chain}: the page at {cursor} ends at {end}, not at {said}")


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[Pages]:
        folder = Folder(self.options)
        return folder.dealt({chain: found for chain, (found, _) in folder.walk_all({}).items()})

    def read(self, pages: Pages) -> Iterator[pa.RecordBatch]:
        return Folder(self.options).rows(pages)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.at: dict[str, str | None] = {}
        self.walked: dict[str, list[str]] = {}  # pages up to ``at`` that no batch has taken yet, so that they aren't followed twice
        self.folder = Folder(options)

    def __reduce__(self):  # tasks need no more
        return _StreamReader, (self.options,)

    def initialOffset(self) -> dict:
        return {"chains": "{}"}

    def latestOffset(self) -> dict:
        for chain, (found, cursor) in self.folder.walk_all(self.at).items():
            self.at[chain] = cursor
            self.walked.setdefault(chain, []).extend(found)
        return {"chains": json.dumps(self.at, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        folder, begin, until = self.folder, json.loads(start["chains"]), json.loads(end["chains"])
        out = {}
        for chain, stop in until.items():
            first = begin.get(chain, FIRST)
            if chain in begin and first == stop:
                continue
            known = self.walked.get(chain, [])
            if stop == self.at.get(chain) and first in known:
                out[chain] = known[known.index(first) :]
            else:  # a batch of before a restart
                out[chain] = folder.walk(chain, first, stop)[0]
        return folder.dealt(out)

    def read(self, pages: Pages) -> Iterator[pa.RecordBatch]:
        return Folder(self.options).rows(pages)

    def commit(self, end: dict) -> None:
        if json.loads(end["chains"]) == self.at:
            self.walked.clear()


class LandedPages(DataSource):
    """``chain, cursor, position, item`` (JSON) of landed pages. Options: ``path``, and ``cursor`` = ``items`` or ``next``."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return "chain string, cursor string, position int, item string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))
