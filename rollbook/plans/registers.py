"""The four registers: which regional sheets they consist of, and how each sheet is read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.operators import dupes, headers, hygiene
from rollbook.plans.consolidate import RegionalSource, align, consolidate
from rollbook.sources import variants
from rollbook.sources.sheets import open_sheets


@dataclass(frozen=True)
class Sheet:
    """One regional sheet: rows above its header at most, columns to drop, and whether to keep only
    the first row of each client."""

    region: str
    preamble: int
    drop: tuple[str, ...] = ()
    keep_first: bool = False


@dataclass(frozen=True)
class Register:
    """Sheets in stacking order. ``layout`` is the region whose column names all take.

    ``anchor`` is a cell that only headers have; ``key`` and ``client`` are repaired names.
    """

    name: str
    sheets: tuple[Sheet, ...]
    layout: str
    rules: tuple[tuple[str, str], ...] | None = headers.REGISTER_RULES
    renames: Mapping[str, str] = field(default_factory=dict)
    drop_empty: bool = False
    anchor: str = "KP Type"
    key: str = "kp_type"
    client: str = "kp_unique_identifier"


# Stacking order, preamble rows, layout region and extra steps of each register.
MSM = Register(
    "MSM",
    (Sheet("LER", 7), Sheet("NRR", 2), Sheet("WKR", 4), Sheet("COR", 0), Sheet("UER", 0)),
    layout="NRR",
    rules=None,
    renames=headers.SNAKE_RENAMES,
    drop_empty=True,
)
FSW = Register(
    "FSW",
    (
        Sheet("COR", 7),
        Sheet("LER", 7, drop=("a",)),
        Sheet("NRR", 2),
        Sheet("WKR", 7),
        Sheet("UER", 7, keep_first=True),
        Sheet("NER", 4, keep_first=True),
    ),
    layout="LER",
)
PWID = Register(
    "PWID",
    (
        Sheet("NER", 4),
        Sheet("COR", 7, drop=("a",)),
        Sheet("UER", 7, drop=("a",)),
        Sheet("WKR", 7, drop=("a",)),
        Sheet("LER", 7, drop=("a",)),
        Sheet("NRR", 2),
    ),
    layout="NRR",
)
TG = Register(
    "TG",
    (Sheet("LER", 7), Sheet("WKR", 7), Sheet("COR", 7), Sheet("NRR", 2), Sheet("UER", 7)),
    layout="NRR",
)
REGISTERS = {r.name: r for r in (MSM, FSW, PWID, TG)}


def consolidate_sheets(
    register: Register,
    landed: Mapping[str, DataFrame],
    renames: Mapping[str, str] | None = None,
) -> DataFrame:
    """One register from the landed sheets of its regions.

    ``renames`` maps repaired headers of the layout sheet to report names; the default takes those
    of the known renames that the layout sheet has.
    """
    sources = []
    for sheet in register.sheets:
        opened = open_sheets(landed[sheet.region], skip=sheet.preamble, anchor=register.anchor)
        sources.append(
            RegionalSource(
                sheet.region,
                opened.drop("source_file", "row_in_sheet"),
                row_id="row_id",
                rules=register.rules,
                drop=sheet.drop,
                keep_first=(register.client,) if sheet.keep_first else (),
            )
        )
    return consolidate(
        sources,
        key=register.key,
        drop_empty=register.drop_empty,
        layout=register.layout,
        renames=_known(sources, register) if renames is None else renames,
    )


def consolidate_records(
    register: Register,
    landed: DataFrame,
    region: Column,
    renames: Mapping[str, str] | None = None,
) -> DataFrame:
    """One register from the landed records of all its files, whatever their headers, in one pass.

    ``region`` tells a file's region from ``source_file``. The files of a region may have several headers. Columns are
    aligned to those of the layout region (its least header, if it has several) by name, and by position only
    between the same known neighbours. Rows come in the order of regions, files and rows (``source_rank``, ``row_in_source``).
    """
    by_region = {s.region: (rank, s) for rank, s in enumerate(register.sheets, start=1)}
    found = variants.find_headers(landed, register.anchor).withColumn("region", region)
    for r in found.groupBy("region").agg(F.max("above").alias("above")).collect():
        if r["region"] not in by_region:
            raise ValueError(f"{register.name} has no region {r['region']!r}")
        if r["above"] > by_region[r["region"]][1].preamble:
            raise ValueError(f"{r['above']} rows above a header of {r['region']}")

    def repaired(own: str, header: Sequence[str | None]) -> list[str | None]:
        """Repaired name of each place; dropped columns have none."""
        names = variants.header_names(header)
        names = headers.clean_headers(names) if register.rules is None else headers.apply_rules(names, register.rules)
        return [None if n in by_region[own][1].drop else n for n in names]

    empty = variants.empty_places(landed, found, region) if register.drop_empty else {}
    pairs = {(r["region"], tuple(r["header"])) for r in found.select("region", "header").distinct().collect()}
    own = sorted((h for r, h in pairs if r == register.layout), key=repr)
    if not own:
        raise ValueError(f"no file gives the layout of {register.layout}")
    layout = [n for n in repaired(register.layout, own[0]) if n]

    def blank(own_region: str, header: Sequence[str | None]) -> list[str]:
        places = empty.get((own_region, tuple(header)), set())
        return [n for i, n in enumerate(repaired(own_region, header)) if n and i in places]

    def column_of(own_region: str, header: Sequence[str | None]) -> dict[str, int]:
        names = repaired(own_region, header)
        matched = align([n for n in names if n], layout, blank(own_region, header), blank(register.layout, own[0]))
        return {wanted: names.index(given) for wanted, given in matched.items()}

    kept = layout
    if register.drop_empty:
        filled = {c for r, h in pairs for c, i in column_of(r, h).items() if i not in empty[(r, h)]}
        kept = [c for c in layout if c in filled]
    rows = variants.open_variants(landed, found.drop("region"), kept, column_of, by=region)
    files = found.select(
        "source_file", F.row_number().over(Window.partitionBy("region").orderBy("source_file")).alias("file")
    )
    rank = F.element_at(F.create_map(*[F.lit(v) for r, (k, _) in by_region.items() for v in (r, k)]), F.col("by"))
    rows = rows.join(files, "source_file").select(
        *[f"`{c}`" for c in kept],
        rank.alias("source_rank"),
        (F.shiftleft(F.col("file").cast("bigint"), 40) + F.col("row_in_sheet")).alias("row_in_source"),
    )
    rows = hygiene.keep_nonblank(rows, register.key)
    once = [k for k, s in by_region.values() if s.keep_first]
    if once:
        first = dupes.first_rows(
            rows.where(F.col("source_rank").isin(once)), ["source_rank", register.client], ["row_in_source"]
        )
        rows = rows.where(~F.col("source_rank").isin(once)).unionByName(first)
    known = {**headers.REGISTER_RENAMES, **register.renames}
    plain = {c.replace("\r\n", "\n") for c in kept}
    chosen = {o: n for o, n in known.items() if o.replace("\r\n", "\n") in plain} if renames is None else renames
    return headers.rename_columns(rows, chosen)


def _known(sources: Sequence[RegionalSource], register: Register) -> dict[str, str]:
    layout = next(s for s in sources if s.name == register.layout).repaired().columns
    plain = {c.replace("\r\n", "\n") for c in layout}
    return {
        old: new
        for old, new in {**headers.REGISTER_RENAMES, **register.renames}.items()
        if old.replace("\r\n", "\n") in plain
    }
