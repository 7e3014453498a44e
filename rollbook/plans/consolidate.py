"""From regional sheets to one register."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.operators import dupes, headers, hygiene, stack


@dataclass(frozen=True)
class RegionalSource:
    """One regional register and how its headers are repaired.

    ``rules=None`` means snake-case headers; otherwise the rule chain is applied. ``row_id`` is the
    column that holds the row order; it becomes lineage and is not part of the layout. Given
    ``keep_first``, only the first row of each value of those (layout) columns is stacked.
    """

    name: str
    frame: DataFrame
    row_id: str
    rules: Sequence[tuple[str, str]] | None = None
    renames: Mapping[str, str] = field(default_factory=dict)
    drop: Sequence[str] = ()
    keep_first: Sequence[str] = ()

    def repaired(self) -> DataFrame:
        content = self.frame.drop(self.row_id).columns
        if self.rules is None:
            names = headers.clean_headers(content)
        else:
            names = headers.apply_rules(content, self.rules)
        by_column = dict(zip(content, names))
        df = headers.rename_by_position(
            self.frame, [by_column.get(c, c) for c in self.frame.columns]
        )
        return headers.rename_columns(df, self.renames).drop(*map(_quoted, self.drop))


def align(
    columns: Sequence[str],
    layout: Sequence[str],
    empty: Sequence[str] = (),
    layout_empty: Sequence[str] = (),
) -> dict[str, str]:
    """Which column of a source gives each layout column; layout columns left out are NULL.

    Columns of the same name belong together. The others are matched by position, but only between
    the same neighbours of known name, so that a known column can't shift. There the counts must
    agree, if need be without the columns that are empty in the source or in the layout.
    """
    shared = set(columns) & set(layout)
    out = {c: c for c in shared}

    def gaps(names: Sequence[str]) -> dict[str | None, list[str]]:
        found: dict[str | None, list[str]] = {}
        last = None
        for name in names:
            if name in shared:
                last = name
            else:
                found.setdefault(last, []).append(name)
        return found

    own, wanted = gaps(columns), gaps(layout)
    for after in {**wanted, **own}:
        mine, theirs = own.get(after, []), wanted.get(after, [])
        filled = [c for c in mine if c not in set(empty)]
        needed = [c for c in theirs if c not in set(layout_empty)]
        for a, b in ((mine, theirs), (filled, theirs), (filled, needed)):
            if len(a) == len(b):
                out.update(zip(b, a))
                break
        else:
            place = "at the start" if after is None else f"after {after!r}"
            raise ValueError(f"columns {filled} {place} cannot take the names {needed}")
    return out


def consolidate(
    sources: Sequence[RegionalSource],
    key: str | None = None,
    drop_empty: bool = True,
    layout: str | None = None,
    renames: Mapping[str, str] | None = None,
) -> DataFrame:
    """Stack regional registers in the given order, under the column names of one of them.

    ``layout`` names the source that gives the column names (default: the first), after
    ``renames``. Columns are aligned by name, and by position only where names differ (``align``);
    registers that do not fit are refused. Each register loses its empty rows and, given ``key``,
    the rows with a blank key. With ``drop_empty``, columns that are empty in every register go;
    which ones is found for all sources in one job.
    """
    frames = [s.repaired() for s in sources]
    contents = [f.drop(s.row_id).columns for f, s in zip(frames, sources)]
    empty = [()] * len(sources)
    if drop_empty:
        empty = hygiene.empty_columns([f.drop(s.row_id) for f, s in zip(frames, sources)])
    chosen = 0 if layout is None else [s.name for s in sources].index(layout)
    names = contents[chosen]
    matched = [align(c, names, e, empty[chosen]) for c, e in zip(contents, empty)]
    kept = names
    if drop_empty:
        kept = [
            n for n in names if any(n in m and m[n] not in set(e) for m, e in zip(matched, empty))
        ]
    final = headers.rename_columns(frames[chosen].select(*map(_quoted, kept)), renames or {}).columns
    kinds = dict(frames[chosen].dtypes)

    aligned = []
    for rank, (df, source, match) in enumerate(zip(frames, sources, matched), start=1):
        df = hygiene.drop_empty_rows(df, lineage=[source.row_id])
        df = stack.with_lineage(df, rank, source.row_id)
        cells = [
            _quoted(match[n]).alias(new) if n in match else F.lit(None).cast(kinds[n]).alias(new)
            for n, new in zip(kept, final)
        ]
        df = df.select(*cells, *stack.LINEAGE)
        if key is not None:
            df = hygiene.keep_nonblank(df, key)
        if source.keep_first:
            df = dupes.first_rows(df, source.keep_first, ["row_in_source"])
        aligned.append(df)
    return stack.stack(aligned)


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")
