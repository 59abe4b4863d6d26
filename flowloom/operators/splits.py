"""Capture groups, partition joins, split balance, coverage and split search."""

from __future__ import annotations

import itertools
from bisect import insort
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.schemas import (
    APPLICATIONS,
    CATEGORIES,
    MINIMUM_CATEGORY_WINDOWS,
    PARTITIONS,
    SPLIT_FRACTIONS,
    VPN_STATUSES,
)
from flowloom.session import cut_lineage

# Importance of each balance metric.
_IMPORTANCE = {
    ("category", "windows"): 10.0,
    ("category", "captures"): 2.0,
    ("all", "windows"): 5.0,
    ("all", "captures"): 1.0,
    ("vpn_status", "windows"): 1.0,
}


class SplitError(ValueError):
    """Raised when no valid partition assignment was found."""


def capture_groups(rows: DataFrame) -> DataFrame:
    """Window count and labels of every capture."""
    return rows.groupBy("capture_id").agg(
        F.min("vpn_status").alias("vpn_status"),
        F.min("application").alias("application"),
        F.min("category").alias("category"),
        F.count(F.lit(1)).alias("windows"),
    )


def _pairs(values: Mapping[str, float]) -> Column:
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])


def _cells(assignments: DataFrame, keys: list[str]) -> DataFrame:
    """Captures and windows per candidate, label group and partition."""
    tagged = assignments.select(
        *keys,
        "partition",
        "windows",
        F.explode(
            F.array(
                F.struct(F.lit("all").alias("kind"), F.lit("all").alias("value")),
                F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")),
                F.struct(F.lit("vpn_status").alias("kind"), F.col("vpn_status").alias("value")),
                F.struct(F.lit("application").alias("kind"), F.col("application").alias("value")),
                F.struct(
                    F.lit("category_vpn").alias("kind"),
                    F.concat_ws("/", "category", "vpn_status").alias("value"),
                ),
            )
        ).alias("g"),
    )
    return tagged.groupBy(
        *keys, F.col("g.kind").alias("kind"), F.col("g.value").alias("value"), "partition"
    ).agg(F.count(F.lit(1)).alias("captures"), F.sum("windows").alias("windows"))


def split_objective(
    assignments: DataFrame,
    *,
    fractions: Mapping[str, float] = SPLIT_FRACTIONS,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """Weighted absolute deviation from the target fractions.

    Sums ``importance / total * |assigned - total * fraction|`` over metrics and
    partitions, for each candidate in ``keys``.
    """
    keys_ = list(keys)
    return _objective(_cells(assignments, keys_), fractions, keys_)


def _objective(cells: DataFrame, fractions: Mapping[str, float], keys: list[str]) -> DataFrame:
    group = [*keys, "kind", "value"]
    spread = cells.where(F.col("kind").isin("all", "category", "vpn_status")).groupBy(*group).agg(
        F.sum("captures").alias("captures_total"),
        F.sum("windows").alias("windows_total"),
        *[
            F.sum(F.when(F.col("partition") == p, F.col(m)).otherwise(0)).alias(f"{m}_{p}")
            for p in PARTITIONS
            for m in ("captures", "windows")
        ],
    )
    cost = F.lit(0.0)
    for (kind, measure), importance in _IMPORTANCE.items():
        total = F.col(f"{measure}_total").cast("double")
        deviation = F.lit(0.0)
        for p in PARTITIONS:
            deviation = deviation + F.abs(F.col(f"{measure}_{p}") - total * fractions[p])
        cost = cost + F.when(
            (F.col("kind") == kind) & (total > 0), F.lit(importance) / total * deviation
        ).otherwise(F.lit(0.0))
    graded = spread.withColumn("cost", cost)
    grouped = graded.groupBy(*keys) if keys else graded
    return grouped.agg(F.sum("cost").alias("objective"))


def _expected_cells(spark, minimum_category_windows: int) -> DataFrame:
    """Every cell the split must fill, with its capture and window floors."""
    rows = [
        ("category", c, p, 1, minimum_category_windows) for c in CATEGORIES for p in PARTITIONS
    ]
    rows += [("application", a, p, 1, 0) for a in APPLICATIONS for p in ("train", "test")]
    rows += [("vpn_status", v, p, 1, 0) for v in VPN_STATUSES for p in PARTITIONS]
    rows += [("category_vpn", f"{c}/{v}", "train", 1, 0) for c in CATEGORIES for v in VPN_STATUSES]
    return spark.createDataFrame(
        rows,
        "kind string, value string, partition string, captures_floor bigint, windows_floor bigint",
    )


def split_coverage(
    assignments: DataFrame, *, minimum_category_windows: int = MINIMUM_CATEGORY_WINDOWS
) -> DataFrame:
    """Required cells with what they hold and whether they reach their floors."""
    wanted = _expected_cells(assignments.sparkSession, minimum_category_windows)
    held = _cells(assignments, [])
    return (
        wanted.join(held, ["kind", "value", "partition"], "left")
        .select(
            "kind",
            "value",
            "partition",
            F.coalesce("captures", F.lit(0)).alias("captures"),
            F.coalesce("windows", F.lit(0)).alias("windows"),
            "captures_floor",
            "windows_floor",
        )
        .withColumn(
            "covered",
            (F.col("captures") >= F.col("captures_floor"))
            & (F.col("windows") >= F.col("windows_floor")),
        )
    )


def split_summary(assignments: DataFrame) -> DataFrame:
    """Captures, windows and window share per partition, in total and by label."""
    cells = _cells(assignments, []).where(F.col("kind") != "category_vpn")
    # Every label kind covers all captures, so its windows add up to the total.
    total = F.sum("windows").over(Window.partitionBy("kind"))
    return cells.select(
        "partition",
        F.col("kind").alias("label_kind"),
        F.col("value").alias("label"),
        "captures",
        "windows",
        (F.col("windows") / total).alias("window_fraction"),
    )


def hashed_partition(key: Column) -> Column:
    """Partition of a key by the first two hex digits of its SHA-256.

    The digits run over 256 values, cut at the rounded cumulative fractions.
    """
    digits = F.substring(F.sha2(key, 256), 1, 2)
    picked, share = F.lit(PARTITIONS[-1]), 1.0
    for name, following in zip(reversed(PARTITIONS[:-1]), reversed(PARTITIONS), strict=False):
        share -= SPLIT_FRACTIONS[following]
        picked = F.when(digits < F.lit(f"{round(share * 256):02x}"), F.lit(name)).otherwise(picked)
    return picked


def candidate_splits(groups: DataFrame, *, seeds: int, first_seed: int = 1) -> DataFrame:
    """One full assignment per seed, built to cover applications and categories.

    In each seed the capture with the smallest hash of an application goes to
    train and the next one to test; of a category's other captures the smallest
    goes to validation and the next to calibration; the rest follow their hash
    in the target fractions.  Ranks come from window filters that are pushed
    below the shuffle, so no task sorts a whole application.
    """
    if seeds < 1:
        raise SplitError("at least one seed is required")
    drawn = groups.select(
        "capture_id", "vpn_status", "application", "category", "windows"
    ).withColumn(
        "seed", F.explode(F.sequence(F.lit(first_seed), F.lit(first_seed + seeds - 1)))
    ).withColumn("_draw", F.sha2(F.concat_ws(":", F.col("seed").cast("string"), "capture_id"), 256))

    def smallest(rows: DataFrame, group: str, names: tuple[str, str]) -> DataFrame:
        order = Window.partitionBy("seed", group).orderBy("_draw", "capture_id")
        return (
            rows.withColumn("_rank", F.row_number().over(order))
            .where(F.col("_rank") <= 2)
            .select(
                "seed",
                "capture_id",
                F.when(F.col("_rank") == 1, F.lit(names[0])).otherwise(F.lit(names[1])).alias(
                    "_forced"
                ),
            )
        )

    fixed = smallest(drawn, "application", ("train", "test"))
    others = drawn.join(fixed, ["seed", "capture_id"], "left_anti")
    forced = fixed.unionByName(smallest(others, "category", ("validation", "calibration")))
    # The first eight hex digits as a fraction of their range.
    uniform = F.conv(F.substring("_draw", 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    free, edge = F.lit(PARTITIONS[-1]), 1.0
    for name in reversed(PARTITIONS[:-1]):
        edge = sum(SPLIT_FRACTIONS[p] for p in PARTITIONS[: PARTITIONS.index(name) + 1])
        free = F.when(uniform < edge, F.lit(name)).otherwise(free)
    return drawn.join(forced, ["seed", "capture_id"], "left").select(
        "seed",
        "capture_id",
        F.coalesce("_forced", free).alias("partition"),
        "vpn_status",
        "application",
        "category",
        "windows",
    )


def grade_splits(
    candidates: DataFrame,
    *,
    minimum_category_windows: int = MINIMUM_CATEGORY_WINDOWS,
    fractions: Mapping[str, float] = SPLIT_FRACTIONS,
    keys: tuple[str, ...] = ("seed",),
) -> DataFrame:
    """Objective and number of unmet coverage cells of each candidate."""
    by = list(keys)
    cells = _cells(candidates, by)
    wanted = _expected_cells(candidates.sparkSession, minimum_category_windows)
    met = (
        cells.join(F.broadcast(wanted), ["kind", "value", "partition"])  # 78 fixed cells
        .where(
            (F.col("captures") >= F.col("captures_floor"))
            & (F.col("windows") >= F.col("windows_floor"))
        )
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_met"))
    )
    total = len(CATEGORIES) * 4 + len(APPLICATIONS) * 2 + len(VPN_STATUSES) * 4
    total += len(CATEGORIES) * len(VPN_STATUSES)
    return (
        _objective(cells, fractions, by)
        .join(met, by, "left")
        .select(
            *by, "objective", (F.lit(total) - F.coalesce("_met", F.lit(0))).alias("violations")
        )
    )


def search_split(
    groups: DataFrame,
    *,
    seeds: int = 64,
    rounds: int | None = None,
    minimum_category_windows: int = MINIMUM_CATEGORY_WINDOWS,
) -> DataFrame:
    """Best covered assignment over seeds, improved by single-capture moves.

    Moves go on until none lowers the objective; ``rounds`` stops sooner.
    Deterministic for the groups and counts given.  It reports the objective it
    reached and never claims the optimum; :class:`SplitError` when no seed gives
    full coverage.  A move is graded from the incumbent's cell totals, once for all
    captures of the same labels, windows and partition; a round reads the captures
    only where it needs more of them by name.
    """
    groups = cut_lineage(groups)  # one row per capture, read by every seed and move
    graded = grade_splits(
        candidate_splits(groups, seeds=seeds),
        minimum_category_windows=minimum_category_windows,
    )
    best = graded.where(F.col("violations") == 0).agg(
        F.min_by("seed", F.struct("objective", "seed")).alias("seed")
    ).first()["seed"]
    if best is None:
        raise SplitError(f"no candidate of {seeds} seeds meets the coverage constraints")
    start = cut_lineage(candidate_splits(groups, seeds=1, first_seed=best).drop("seed"))
    holdings = _Holdings(_cells(start, []).collect())  # label groups x partitions only
    members = _Members.of(start)
    moved: dict[str, str] = {}
    for done in itertools.count():
        if done == rounds:
            break
        if members is None:
            best_moves = _best_moves(
                _with_moves(start, moved), holdings.cells(), minimum_category_windows, MOST_MOVES
            )
        else:
            best_moves = members.best_moves(holdings, minimum_category_windows, MOST_MOVES)
        taken = _improving_moves(holdings, best_moves, minimum_category_windows)
        if not taken:
            break
        moved |= {move["capture_id"]: move["target"] for move in taken}
        if members is not None:
            members.apply(taken)
    return _with_moves(start, moved)


def _with_moves(start: DataFrame, moved: Mapping[str, str]) -> DataFrame:
    """The assignment after moves."""
    if not moved:
        return start
    targets = start.sparkSession.createDataFrame(
        list(moved.items()), "capture_id string, _target string"
    )
    return start.join(F.broadcast(targets), "capture_id", "left").select(
        "capture_id",
        F.coalesce("_target", "partition").alias("partition"),
        *[c for c in start.columns if c not in ("capture_id", "partition")],
    )


class _Holdings:
    """Captures and windows of each label group and partition."""

    def __init__(self, cells: list):
        self.held = {(r["kind"], r["value"], r["partition"]): [r["captures"], r["windows"]] for r in cells}
        self.whole: dict[tuple[str, str], list[int]] = {}
        for (kind, value, _), amounts in self.held.items():
            total = self.whole.setdefault((kind, value), [0, 0])
            total[0] += amounts[0]
            total[1] += amounts[1]

    @staticmethod
    def _values(move) -> dict[str, str]:
        return {
            "all": "all",
            "category": move["category"],
            "vpn_status": move["vpn_status"],
            "application": move["application"],
            "category_vpn": f"{move['category']}/{move['vpn_status']}",
        }

    def at(self, kind: str, value: str, partition: str) -> list[int]:
        return self.held.get((kind, value, partition), [0, 0])

    def gain(self, move) -> float:
        """Change of the objective by a move."""
        values, change = self._values(move), 0.0
        for (kind, name), importance in _IMPORTANCE.items():
            measure = 0 if name == "captures" else 1
            size = 1 if measure == 0 else move["windows"]
            total = self.whole[kind, values[kind]][measure]
            for partition, sign in ((move["partition"], -1), (move["target"], 1)):
                held = self.at(kind, values[kind], partition)[measure]
                wanted = total * SPLIT_FRACTIONS[partition]
                moved = abs(held + sign * size - wanted) - abs(held - wanted)
                change += importance / total * moved
        return change

    def covered_after(self, move, minimum_category_windows: int) -> bool:
        """Whether the move leaves every required cell filled."""
        values, source = self._values(move), move["partition"]
        category = self.at("category", values["category"], source)
        needed = ["category", "vpn_status"]
        needed += ["application"] if source in ("train", "test") else []
        needed += ["category_vpn"] if source == "train" else []
        return category[1] - move["windows"] >= minimum_category_windows and all(
            self.at(kind, values[kind], source)[0] > 1 for kind in needed
        )

    def cells(self) -> list[dict]:
        """The held amounts as rows."""
        names = ("kind", "value", "partition", "captures", "windows")
        return [dict(zip(names, (*at, *held), strict=True)) for at, held in self.held.items()]

    def gains(
        self, kinds: list[tuple], minimum_category_windows: int
    ) -> list[tuple[float, int, str]]:
        """Gain, kind and target of the moves that help and keep coverage, best first.

        The sums are those of :meth:`gain` in the same order, over all kinds at once.
        """
        names = ("vpn_status", "application", "category", "windows", "partition")
        moves = [dict(zip(names, kind, strict=True)) for kind in kinds]
        kept = [i for i, m in enumerate(moves) if self.covered_after(m, minimum_category_windows)]
        if not kept:
            return []
        moves = [moves[i] for i in kept]
        values = [self._values(move) for move in moves]
        windows = np.array([float(move["windows"]) for move in moves])
        sources = np.array([move["partition"] for move in moves])
        found = []
        for target in PARTITIONS:
            change = np.zeros(len(moves))
            for (kind, name), importance in _IMPORTANCE.items():
                measure = 0 if name == "captures" else 1
                size = 1.0 if measure == 0 else windows
                total = np.array([float(self.whole[kind, v[kind]][measure]) for v in values])
                for ends, sign in ((sources, -1), ([target] * len(moves), 1)):
                    held = np.array(
                        [self.at(kind, v[kind], p)[measure] for v, p in zip(values, ends, strict=True)],
                        dtype=float,
                    )
                    wanted = total * np.array([SPLIT_FRACTIONS[p] for p in ends])
                    moved = np.abs(held + sign * size - wanted) - np.abs(held - wanted)
                    change += importance / total * moved
            helps = (change < -1e-9) & (sources != target)
            found += [(float(change[i]), kept[i], target) for i in np.flatnonzero(helps)]
        return sorted(found)

    def apply(self, move) -> None:
        for kind, value in self._values(move).items():
            for partition, sign in ((move["partition"], -1), (move["target"], 1)):
                held = self.held.setdefault((kind, value, partition), [0, 0])
                held[0] += sign
                held[1] += sign * move["windows"]


def _improving_moves(holdings: _Holdings, moves: list, minimum_category_windows: int) -> list:
    """Moves that lower the objective one after another, keeping coverage.

    Each is graded again after those before it, so only moves that still help are
    taken, and the holdings follow.  Of the best single moves the first always helps.
    """
    taken: dict[str, object] = {}
    for move in moves:
        if move["capture_id"] in taken or holdings.gain(move) >= -1e-9:
            continue
        if holdings.covered_after(move, minimum_category_windows):
            holdings.apply(move)
            taken[move["capture_id"]] = move
    return list(taken.values())


#: Moves graded in a round, and kinds of captures whose moves are graded together.
MOST_MOVES = 256
MOST_KINDS = 100_000


class _Members:
    """Captures by kind: labels, windows and partition.

    Captures of a kind have the same moves with the same gains, so a round grades one
    move per kind and target.  Which captures they are is asked of the start table by
    kind, the smallest ids first and only as many as rounds use.
    """

    _TRAITS = ("vpn_status", "application", "category", "windows")

    def __init__(self, start: DataFrame, counts: list):
        self._start = start
        self._count = {tuple(r)[:-1]: r["count"] for r in counts}
        self._first: dict[tuple, list[str]] = {}  # smallest ids of a kind at the start
        self._left: dict[tuple, set[str]] = {}
        self._come: dict[tuple, list[str]] = {}

    @classmethod
    def of(cls, start: DataFrame) -> _Members | None:
        """The kinds of a start table; none where there are too many to hold."""
        counts = start.groupBy(*cls._TRAITS, "partition").count()
        rows = counts.limit(MOST_KINDS + 1).collect()
        return None if len(rows) > MOST_KINDS else cls(start, rows)

    def _ask(self, kinds: list[tuple], most: int) -> None:
        """Read the smallest ids of kinds whose known ones do not reach ``most``."""
        wanted: dict[int, list[tuple]] = {}
        for kind in kinds:
            known, gone = self._first.get(kind, []), self._left.get(kind, ())
            whole = self._count.get(kind, 0)
            if len(known) < whole and len(known) - len(gone) < most:
                depth = 1 << (most + len(gone) - 1).bit_length() + 1
                wanted.setdefault(depth, []).append(kind)
        spark, by = self._start.sparkSession, [*self._TRAITS, "partition"]
        schema = self._start.select(*by).schema
        for depth, some in wanted.items():
            asked = spark.createDataFrame(some, schema)
            same = [self._start[c].eqNullSafe(asked[c]) for c in by]
            ranked = Window.partitionBy(*by).orderBy("capture_id")
            rows = (
                self._start.join(F.broadcast(asked), same, "left_semi")
                .withColumn("_rank", F.row_number().over(ranked))
                .where(F.col("_rank") <= depth)
                .select(*by, "capture_id")
                .collect()
            )
            for kind in some:
                self._first[kind] = []
            for row in rows:
                self._first[tuple(row)[:-1]].append(row["capture_id"])
            for kind in some:
                self._first[kind].sort()

    def _smallest(self, kind: tuple, most: int) -> list[str]:
        """The smallest ids a kind has now."""
        known, gone = self._first.get(kind, []), self._left.get(kind, ())
        here = list(itertools.islice((c for c in known if c not in gone), most))
        return sorted([*here, *self._come.get(kind, [])[:most]])[:most]

    def best_moves(self, holdings: _Holdings, minimum_category_windows: int, most: int) -> list:
        """As :func:`_best_moves`, by gain, capture and target."""
        kinds = [k for k in {**self._count, **self._come} if self._size(k)]
        graded = holdings.gains(kinds, minimum_category_windows)
        # As many kinds as may be needed now, and as many again for the rounds to come.
        ahead, held = [], 0
        for _, at, _ in graded:
            ahead.append(kinds[at])
            held += self._size(kinds[at])
            if held >= 16 * most:
                break
        short = {
            kinds[at] for _, at, _ in self._reach(graded, kinds, most) if self._short(kinds[at], most)
        }
        if short:
            self._ask(list(dict.fromkeys([*short, *ahead])), most)
        found: list[dict] = []
        for gain, same in itertools.groupby(graded, key=lambda g: g[0]):
            need = most - len(found)
            if need <= 0:
                break
            rows = sorted(
                (capture, target, kinds[at])
                for _, at, target in same
                for capture in self._smallest(kinds[at], need)
            )
            found += [
                dict(zip((*self._TRAITS, "partition"), kind, strict=True))
                | {"capture_id": capture, "target": target, "gain": gain}
                for capture, target, kind in rows[:need]
            ]
        return found

    def _size(self, kind: tuple) -> int:
        gone, come = self._left.get(kind, ()), self._come.get(kind, ())
        return self._count.get(kind, 0) - len(gone) + len(come)

    def _reach(self, graded: list, kinds: list[tuple], most: int):
        """Moves by kind that hold the best ``most``, whole groups of equal gain."""
        held = 0
        for _, same in itertools.groupby(graded, key=lambda g: g[0]):
            if held >= most:
                return
            for move in same:
                held += self._size(kinds[move[1]])
                yield move

    def _short(self, kind: tuple, most: int) -> bool:
        known, gone = self._first.get(kind, ()), self._left.get(kind, ())
        return len(known) < self._count.get(kind, 0) and len(known) - len(gone) < most

    def apply(self, moves: list) -> None:
        for move in moves:
            capture, traits = move["capture_id"], tuple(move[c] for c in self._TRAITS)
            source, target = (*traits, move["partition"]), (*traits, move["target"])
            come = self._come.get(source, [])
            if capture in come:
                come.remove(capture)
            else:
                self._left.setdefault(source, set()).add(capture)
            # One that comes back to where it started is no newcomer.
            if capture in self._left.get(target, ()):
                self._left[target].remove(capture)
            else:
                insort(self._come.setdefault(target, []), capture)


def _best_moves(
    current: DataFrame, cells: list, minimum_category_windows: int, most: int
) -> list:
    """The single moves that lower the objective most while keeping coverage."""
    totals = {
        (r["kind"], r["value"], r["partition"]): (r["captures"], r["windows"]) for r in cells
    }
    group_total: dict[tuple[str, str], list[int]] = {}
    for (kind, value, _), (captures, windows) in totals.items():
        held = group_total.setdefault((kind, value), [0, 0])
        held[0] += captures
        held[1] += windows

    def amounts(measure: int, kind: str, value: Column, partition: Column) -> Column:
        found = {
            f"{v}|{p}": float(held[measure]) for (k, v, p), held in totals.items() if k == kind
        }
        return F.coalesce(
            F.element_at(_pairs(found), F.concat_ws("|", value, partition)), F.lit(0.0)
        )

    def whole(measure: int, kind: str, value: Column) -> Column:
        found = {v: float(held[measure]) for (k, v), held in group_total.items() if k == kind}
        return F.element_at(_pairs(found), value)

    targets = F.array(*[F.lit(p) for p in PARTITIONS])
    moves = current.withColumn("target", F.explode(targets)).where(
        F.col("target") != F.col("partition")
    )
    labels = {
        "all": F.lit("all"),
        "category": F.col("category"),
        "vpn_status": F.col("vpn_status"),
    }
    share = _pairs(SPLIT_FRACTIONS)
    gain = F.lit(0.0)
    for (kind, measure_name), importance in _IMPORTANCE.items():
        measure = 0 if measure_name == "captures" else 1
        size = F.lit(1.0) if measure == 0 else F.col("windows").cast("double")
        total = whole(measure, kind, labels[kind])
        for partition, sign in (("partition", -1.0), ("target", 1.0)):
            held = amounts(measure, kind, labels[kind], F.col(partition))
            wanted = total * F.element_at(share, F.col(partition))
            change = F.abs(held + sign * size - wanted) - F.abs(held - wanted)
            gain = gain + F.lit(importance) / total * change
    source = F.col("partition")
    keeps = (
        (amounts(0, "category", F.col("category"), source) > 1)
        & (
            amounts(1, "category", F.col("category"), source) - F.col("windows")
            >= minimum_category_windows
        )
        & (amounts(0, "vpn_status", F.col("vpn_status"), source) > 1)
        & (
            ~source.isin("train", "test")
            | (amounts(0, "application", F.col("application"), source) > 1)
        )
        & (
            (source != "train")
            | (
                amounts(
                    0, "category_vpn", F.concat_ws("/", "category", "vpn_status"), source
                )
                > 1
            )
        )
    )
    return (
        moves.where(keeps)
        .withColumn("gain", gain)
        .where(F.col("gain") < -1e-9)
        .orderBy("gain", "capture_id", "target")
        .limit(most)
        .collect()
    )


def join_partitions(rows: DataFrame, assignments: DataFrame) -> DataFrame:
    """Give every row of an assigned capture its partition."""
    return rows.join(assignments.select("capture_id", "partition"), "capture_id")


def partition_faults(rows: DataFrame, assignments: DataFrame) -> DataFrame:
    """Unassigned captures, label mismatches and window-count differences.

    Rows are first reduced to one line per capture and label combination.
    """
    labels = ["vpn_status", "application", "category"]
    seen = cut_lineage(
        rows.groupBy("capture_id", *labels).agg(F.count(F.lit(1)).alias("observed"))
    )
    unassigned = seen.join(assignments, "capture_id", "left_anti").select(
        F.lit("capture_unassigned").alias("rule"),
        F.col("capture_id").alias("key"),
        F.col("observed").cast("string").alias("detail"),
    )
    same = F.lit(True)
    for c in labels:
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"a.{c}"))
    mismatched = (
        seen.alias("s")
        .join(assignments.alias("a"), "capture_id")
        .where(~same)
        .select(
            F.lit("label_mismatch").alias("rule"),
            F.col("capture_id").alias("key"),
            F.concat_ws("/", *[F.col(f"s.{c}") for c in labels]).alias("detail"),
        )
    )
    counts = seen.groupBy("capture_id").agg(F.sum("observed").alias("observed"))
    different = (
        counts.join(assignments.select("capture_id", "windows"), "capture_id", "full_outer")
        .where(~F.col("observed").eqNullSafe(F.col("windows")))
        .select(
            F.lit("window_count").alias("rule"),
            F.col("capture_id").alias("key"),
            F.concat_ws(
                "<>",
                F.coalesce(F.col("observed"), F.lit(0)),
                F.coalesce(F.col("windows"), F.lit(0)),
            ).alias("detail"),
        )
    )
    return unassigned.unionByName(mismatched).unionByName(different)


def capture_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Captures present on both sides; must be empty between partitions."""
    return left.select("capture_id").intersect(right.select("capture_id"))


def missing_values(rows: DataFrame, column: str, expected: tuple[str, ...]) -> DataFrame:
    """Values missing from a column or not expected in it."""
    wanted = rows.sparkSession.createDataFrame([(v,) for v in expected], f"{column} string")
    seen = rows.select(column).distinct()
    missing = wanted.exceptAll(seen).withColumn("fault", F.lit("missing"))
    return missing.unionByName(seen.exceptAll(wanted).withColumn("fault", F.lit("unexpected")))


def union_partitions(partitions: Mapping[str, DataFrame]) -> DataFrame:
    """Partitions put together in canonical order of roles."""
    parts = [partitions[p].withColumn("partition", F.lit(p)) for p in PARTITIONS if p in partitions]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
