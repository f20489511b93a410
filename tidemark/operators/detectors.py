"""Domain detectors composed from the general operators: presence, silence, speed, encounters, trips."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import angle_between, bearing_deg, boundaries_crossed, clip, grid_cell, haversine_m, known_text, micros, normal_text, seconds_between, time_bucket, valid_imo
from tidemark.operators.aggregates import fit_circles, modal_value, supported_ratio
from tidemark.operators.geometry import distance_to_land
from tidemark.operators.joins import asof_join, next_event, overlapping_pairs, points_in_intervals, proximity_pairs, that_overlap
from tidemark.operators.timeline import pair_with_previous, sessionize
from tidemark.storage import written

#: Probability that a silence is deliberate, by verdict, and its limits for long ones.
VERDICT_PROBABILITY = {"receiver_alive": 0.9, "area_dark": 0.15, "no_evidence": 0.5}
LONG_GAP_HOURS, LONG_GAP_LOW, LONG_GAP_HIGH = 12.0, 0.4, 0.6
KNOT_M_PER_S = 1852.0 / 3600.0
#: Weights of an encounter's scores.
ENCOUNTER_WEIGHTS = {"rendezvous": 0.35, "codrift": 0.20, "ship_type": 0.20, "nav_status": 0.10, "repetition": 0.10, "duration": 0.05}
SERVICE_SHIP_TYPES = ("Tug", "Pilot", "Port tender", "SAR", "Law enforcement", "Dredging", "Anti-pollution", "Diving", "Towing", "Towing long/wide")
MOORED = ("Moored", "At anchor")
#: Fixed values of encounters: metres of drift with full credit, hours from which a long one counts less and not at all,
#: metres from an anchorage that are offshore, and the metres or knots of a vessel that came or went.
CODRIFT_M, LONG_HOURS, ANCHORAGE_M, APPROACH_M, TRANSIT_KNOTS = 500.0, (24.0, 72.0), 10_000.0, 2_000.0, 3.0
UNDEFINED_STATUS = ("Undefined", "Unknown", "", "Not defined")


def presence(df: DataFrame, cell: Sequence[str], ts: str, key: str, flag: Column | None = None) -> DataFrame:
    """One row per cell, hour and key: messages, first and last time, and whether any has the flag."""
    hour = time_bucket(F.col(ts), 3600).alias("cell_hour")
    flags = [F.bool_or(flag).alias("flag")] if flag is not None else []
    return df.groupBy(*cell, hour, key).agg(F.count("*").alias("n_messages"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), *flags)


def coverage_map(df: DataFrame, key: str, ts: str, lat: str, lon: str, kind: str, cell_deg: float = 0.1, short_seconds: float = 1800, least: int = 20) -> DataFrame:
    """Share of short gaps by the cell and kind of the earlier position of each pair; null under `least` pairs."""
    pairs = pair_with_previous(df, [key], ts, [lat, lon, kind])
    cells = pairs.select(grid_cell(F.col(f"prev_{lat}"), cell_deg).alias("cell_lat"), grid_cell(F.col(f"prev_{lon}"), cell_deg).alias("cell_lon"), F.col(f"prev_{kind}").alias(kind), (seconds_between(F.col(ts), F.col(f"prev_{ts}")) <= short_seconds).alias("__short"))
    return supported_ratio(cells, ["cell_lat", "cell_lon", kind], F.col("__short"), least, "n_pairs", "n_short_pairs", "coverage_probability")


def cells_within(df: DataFrame, lat: str, lon: str, cell_deg: float, ring: int) -> DataFrame:
    """A row for each grid cell at most `ring` cells away from the position's own."""
    steps = F.sequence(F.lit(-ring), F.lit(ring))
    rows = df.withColumn("__i", F.explode(steps)).withColumn("__j", F.explode(steps))
    return rows.withColumns({"cell_lat": F.round(grid_cell(F.col(lat), cell_deg) + F.col("__i") * cell_deg, 6), "cell_lon": F.round(grid_cell(F.col(lon), cell_deg) + F.col("__j") * cell_deg, 6)}).drop("__i", "__j")


def counted_below(x: np.ndarray, y: np.ndarray, below: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """How many points have x < below and y <= upto, for each such limit: ranks of y, in the order of x, halved bit by bit."""
    order = np.argsort(x, kind="stable")
    rank = np.empty(len(y), np.int64)
    rank[np.argsort(y, kind="stable")] = np.arange(len(y))
    ranks, low, high = rank[order], np.zeros(len(below), np.int64), np.searchsorted(x[order], below, side="left")
    most, out = np.searchsorted(np.sort(y), upto, side="right"), np.zeros(len(below), np.int64)
    for bit in reversed(range(len(y).bit_length())):
        zero = (ranks >> bit & 1) == 0
        zeros = np.concatenate(([0], np.cumsum(zero)))
        upper = (most >> bit & 1) == 1
        out += np.where(upper, zeros[high] - zeros[low], 0)
        low, high = (np.where(upper, zeros[-1] + i - zeros[i], zeros[i]) for i in (low, high))
        ranks = np.concatenate((ranks[zero], ranks[~zero]))
    return out


def liveness_verdict(gaps: DataFrame, cells: DataFrame, seen: DataFrame, gap_id: Sequence[str], cell: Sequence[str], key: str, start: str = "gap_start", end: str = "gap_end", baseline_days: int = 30, min_corroborators: int = 1, min_expected: float = 3.0, min_baseline: int = 3) -> DataFrame:
    """Whether others were heard around a key's silence.

    gaps have a key, start and end; cells list each gap's cells; seen is `presence`. Others heard
    during the gap prove a live receiver. If none were, but the baseline (whole days before the
    gap's) would have several heard, the area was dark; else nothing is known. A gap's own key never
    counts.

    No gap meets the keys heard around it. Gaps of the same cells have one place. A key counts for a
    gap by the first of its presences that ends no sooner than the gap begins, so a presence counts
    for the gaps that begin after all sooner ones of its key have ended: places and days count such
    presences for their gaps together (`counted_below`). The baseline is a running sum over a
    place's days, with each key in where a window of days first reaches it and out where none does.
    """
    first_day = F.unix_date(F.col(start).cast("date"))
    last_day = F.greatest(first_day, F.unix_date(F.col(end).cast("date")))
    g = gaps.select(*gap_id, *(c for c in (key, start, end) if c not in gap_id))
    spots = cells.groupBy(*gap_id).agg(F.array_sort(F.collect_set(F.struct(*cell))).alias("__cells"))  # one gap's
    places = written(spots.select("__cells").distinct().withColumn("__place", F.monotonically_increasing_id()), "places")
    lowest = F.lit(-(1 << 63)).cast("long")
    asked = g.where(F.col(key).isNotNull() & F.col(start).isNotNull()).join(spots, list(gap_id)).join(places, "__cells")
    asked = written(asked.select(*gap_id, "__place", F.col(key).alias("__key"), micros(F.col(start)).alias("__s"), F.coalesce(micros(F.col(end)), lowest).alias("__e"), first_day.alias("__day"), last_day.alias("__until")).withColumn("__gap", F.monotonically_increasing_id()), "gaps")
    there = places.select("__place", F.explode("__cells").alias("c")).select("__place", "c.*")
    heard = seen.where(F.col(key).isNotNull()).join(there.hint("merge"), list(cell)).select("__place", F.col(key).alias("__key"), micros(F.col("first_seen")).alias("__f"), micros(F.col("last_seen")).alias("__l"), F.unix_date(F.col("cell_hour").cast("date")).alias("__day"))
    heard = written(heard, "heard")
    # presences and the latest end of sooner ones of their key
    sooner = Window.partitionBy("__place", "__key").orderBy("__f", "__l").rowsBetween(Window.unboundedPreceding, -1)
    points = heard.withColumn("__x", F.coalesce(F.max("__l").over(sooner), lowest)).where("__x < __l")
    asks = asked.withColumn("__day", F.explode(F.sequence("__day", "__until")))
    both = points.select("__place", "__day", F.lit(-1).cast("long").alias("__gap"), F.col("__x").alias("a"), F.col("__f").alias("b"), F.col("__l").alias("c")).unionByName(asks.select("__place", "__day", "__gap", F.col("__s").alias("a"), F.col("__e").alias("b"), lowest.alias("c")))

    def met(table):
        gap, a, b, c = (table.column(n).to_numpy() for n in ("__gap", "a", "b", "c"))
        p, q = gap < 0, gap >= 0
        n = counted_below(a[p], b[p], a[q], b[q]) - counted_below(c[p], b[p], a[q], b[q])
        return pa.table({"__gap": gap[q], "__met": n})

    alive = both.groupBy("__place", "__day").applyInArrow(met, "__gap long, __met long").groupBy("__gap").agg(F.sum("__met").alias("__met"))
    # what the own key adds to all of these
    own = heard.select("__place", "__key", "__day", F.lit(None).cast("long").alias("__gap"), F.col("__l").alias("__t"), "__f").unionByName(asked.select("__place", "__key", "__day", "__gap", F.col("__s").alias("__t"), F.lit(None).cast("long").alias("__f"), "__e"), allowMissingColumns=True)
    each = Window.partitionBy("__place", "__key")
    own = own.withColumn("__first", F.min("__f").over(each.orderBy(F.desc("__t")).rangeBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("__own_hours", F.count("__f").over(each.orderBy("__day").rangeBetween(-baseline_days, -1)))
    own = own.where("__gap is not null").select("__gap", F.coalesce((F.col("__first") <= F.col("__e")).cast("long"), F.lit(0)).alias("__own"), "__own_hours")
    # hours and keys of the days before each day that a gap begins on
    daily = heard.groupBy("__place", "__key", "__day").agg(F.count("*").alias("__n"))
    by_day = each.orderBy("__day")
    enters, leaves = (F.coalesce((x > baseline_days).cast("long"), F.lit(1)) for x in (F.col("__day") - F.lag("__day").over(by_day), F.lead("__day").over(by_day) - F.col("__day")))
    daily = daily.withColumns({"__in": enters, "__out": leaves})
    steps = daily.select("__place", F.explode(F.array(F.struct((F.col("__day") + 1).alias("d"), F.col("__n").alias("h"), F.col("__in").alias("k")), F.struct((F.col("__day") + baseline_days + 1).alias("d"), (-F.col("__n")).alias("h"), (-F.col("__out")).alias("k")))).alias("x")).select("__place", F.col("x.d").alias("__day"), "x.h", "x.k")
    days = asked.select("__place", "__day").distinct().withColumns({"h": F.lit(0).cast("long"), "k": F.lit(0).cast("long"), "asked": F.lit(1)})
    so_far = Window.partitionBy("__place").orderBy("__day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = steps.unionByName(days, allowMissingColumns=True).groupBy("__place", "__day").agg(F.sum("h").alias("h"), F.sum("k").alias("k"), F.max("asked").alias("asked"))
    sums = sums.withColumns({"h": F.sum("h").over(so_far), "k": F.sum("k").over(so_far)}).where("asked = 1").drop("asked")
    counted = asked.join(sums, ["__place", "__day"]).join(own, "__gap").join(alive, "__gap", "left")
    counted = counted.select(*gap_id, (F.coalesce("__met", F.lit(0)) - F.col("__own")).alias("n_corroborators"), (F.col("h") - F.col("__own_hours")).alias("__hours"), (F.col("k") - (F.col("__own_hours") > 0).cast("long")).alias("n_baseline"))
    out = g.join(counted, list(gap_id), "left").fillna(0, ["n_corroborators", "__hours", "n_baseline"])
    expected = F.col("__hours") / (baseline_days * 24.0) * seconds_between(F.col(end), F.col(start)) / 3600
    out = out.withColumn("expected", expected)
    verdict = F.when(F.col("n_corroborators") >= min_corroborators, "receiver_alive").when((F.col("expected") >= min_expected) & (F.col("n_baseline") >= min_baseline), "area_dark").otherwise("no_evidence")
    return out.withColumn("verdict", verdict).drop("__hours")


def gap_probability(verdict: Column, hours: Column) -> Column:
    """Probability by verdict, kept in the middle band for long gaps."""
    p = F.lit(None).cast("double")
    for name, value in VERDICT_PROBABILITY.items():
        p = F.when(verdict == name, value).otherwise(p)
    return F.when(hours >= LONG_GAP_HOURS, clip(p, LONG_GAP_LOW, LONG_GAP_HIGH)).otherwise(p)


def impossible_speed(df: DataFrame, key: str, ts: str, lat: str, lon: str, max_knots: float = 50.0, min_seconds: float = 60.0, tie: Sequence[str] = ()) -> DataFrame:
    """Consecutive positions at least min_seconds apart that imply more than max_knots."""
    p = pair_with_previous(df, [key], ts, [lat, lon], tie)
    s = seconds_between(F.col(ts), F.col(f"prev_{ts}"))
    p = p.withColumn("elapsed_seconds", s).withColumn("speed_knots", haversine_m(F.col(f"prev_{lat}"), F.col(f"prev_{lon}"), F.col(lat), F.col(lon)) / F.nullif(F.col("elapsed_seconds"), F.lit(0.0)) / KNOT_M_PER_S)
    hits = p.where((F.col("elapsed_seconds") >= min_seconds) & (F.col("speed_knots") > max_knots))
    return hits.withColumn("confidence", F.when(F.col("speed_knots") >= 2 * max_knots, 1.0).otherwise((F.col("speed_knots") - max_knots) / max_knots))


def simultaneous_positions(df: DataFrame, key: str, ts: str, lat: str, lon: str, row_id: str, min_m: float = 500.0, full_m: float = 5000.0) -> DataFrame:
    """Two positions of one key at one time, more than min_m apart."""
    a = df.select(key, ts, *(F.col(c).alias(f"{c}_a") for c in (row_id, lat, lon)))
    b = df.select(key, ts, *(F.col(c).alias(f"{c}_b") for c in (row_id, lat, lon)))
    d = haversine_m(F.col(f"{lat}_a"), F.col(f"{lon}_a"), F.col(f"{lat}_b"), F.col(f"{lon}_b"))
    out = a.join(b, [key, ts]).where(F.col(f"{row_id}_a") < F.col(f"{row_id}_b")).withColumn("distance_m", d).where(F.col("distance_m") > min_m)
    return out.withColumn("confidence", F.when(F.col("distance_m") >= full_m, 1.0).otherwise(F.col("distance_m") / full_m))


def synthetic_circles(df: DataFrame, trip: str, ts: str, lat: str, lon: str, least: int = 20, min_hours: float = 1.0, min_radius: float = 50.0, max_radius: float = 20_000.0, max_residual: float = 0.03, max_resultant: float = 0.6) -> DataFrame:
    """Trips whose positions lie on a circle: small residual against the radius, directions spread around."""
    span = df.groupBy(trip).agg(F.count("*").alias("__n"), F.avg(lat).alias("__lat"), F.avg(lon).alias("__lon"), F.min(ts).alias("start_time"), seconds_between(F.max(ts), F.min(ts)).alias("__s"))
    some = span.where((F.col("__n") >= least) & (F.col("__s") >= min_hours * 3600))
    flat = df.join(some, trip).withColumns({"__x": (F.col(lon) - F.col("__lon")) * 111_320.0 * F.cos(F.radians("__lat")), "__y": (F.col(lat) - F.col("__lat")) * 111_320.0})
    fits = fit_circles(flat.select(trip, "__x", "__y"), [trip], "__x", "__y", least)
    ok = F.col("radius").between(min_radius, max_radius) & (F.col("rms_residual") <= max_residual * F.col("radius")) & (F.col("resultant") <= max_resultant)
    return fits.where(ok).join(some.select(trip, "start_time"), trip)


def stay_cells(df: DataFrame, key: str, ts: str, stay: str, cell: Column, least_hours: float = 3.0, least_vessels: int = 5) -> DataFrame:
    """Cells where several keys stay: the longest stay per key, cell and day counts if it is long enough.

    cell is an aggregate over a stay's rows. Members are sorted lists of keys.
    """
    stays = df.groupBy(key, stay).agg(F.min(ts).cast("date").alias("day"), cell.alias("cell"), (seconds_between(F.max(ts), F.min(ts)) / 3600).alias("hours"))
    days = stays.groupBy("cell", key, "day").agg(F.max("hours").alias("hours")).where(F.col("hours") >= least_hours)
    out = days.groupBy("cell").agg(F.count_distinct(key).alias("n_vessels"), F.count("*").alias("n_vessel_days"), F.sum("hours").alias("total_hours"), F.array_sort(F.collect_set(key)).alias("members"))
    return out.where(F.col("n_vessels") >= least_vessels)


def anchorages(df: DataFrame, key: str, ts: str, lat: str, lon: str, sog: str, cell_deg: float = 0.01, max_sog: float = 0.5, max_dwell_gap_seconds: float = 1800, least_hours: float = 3.0, least_vessels: int = 5) -> DataFrame:
    """Grid cells where vessels lie still: stays split at gaps over half an hour and at changes of cell."""
    still = df.where(F.col(sog) < max_sog).withColumns({"cell_lat": grid_cell(F.col(lat), cell_deg), "cell_lon": grid_cell(F.col(lon), cell_deg)})
    stays = sessionize(still, [key, "cell_lat", "cell_lon"], ts, max_dwell_gap_seconds, name="stay")
    found = stay_cells(stays.withColumn("stay", F.struct("cell_lat", "cell_lon", "stay")), key, ts, "stay", F.first(F.struct("cell_lat", "cell_lon")), least_hours, least_vessels)
    return found.select(F.col("cell.cell_lat").alias("cell_lat"), F.col("cell.cell_lon").alias("cell_lon"), (F.col("cell.cell_lat") + cell_deg / 2).alias("center_latitude"), (F.col("cell.cell_lon") + cell_deg / 2).alias("center_longitude"), "n_vessels", "n_vessel_days", "total_hours", "members")


def coastal_flag(cells: DataFrame, land: DataFrame, max_m: float = 10_000.0, polygon_id: str = "polygon", rings: str = "rings") -> DataFrame:
    """anchorages with distance_to_land_m from their centres (0 on land, null beyond max_m) and is_coastal, within max_m of it."""
    places = cells.select(F.struct("cell_lat", "cell_lon").alias("place"), "center_latitude", "center_longitude")
    far = distance_to_land(places, land, "place", "center_latitude", "center_longitude", max_m, polygon_id, rings)
    near = far.select("place.cell_lat", "place.cell_lon", F.col("distance_m").alias("distance_to_land_m"))
    return cells.join(near, ["cell_lat", "cell_lon"], "left").withColumn("is_coastal", F.coalesce(F.col("distance_to_land_m") <= max_m, F.lit(False)))


def slots(df: DataFrame, key: str, ts: str, lat: str, lon: str, sog: str, minutes: int = 10, status: str | None = None) -> DataFrame:
    """Medians of position and speed per key and time slot, and the highest speed; with a status its most frequent value, ties to the smallest."""
    slot = time_bucket(F.col(ts), minutes * 60).alias("slot")
    if status:
        modal = modal_value(df.select(key, slot, status), [key, "slot"], status).drop("n")
        return slots(df, key, ts, lat, lon, sog, minutes).join(modal, [key, "slot"], "left")
    return df.groupBy(key, slot).agg(F.median(lat).alias("latitude"), F.median(lon).alias("longitude"), F.median(sog).alias("sog"), F.max(sog).alias("max_sog"))


def pair_slots(slotted: DataFrame, key: str, max_sog: float = 3.0, max_m: float = 500.0, grid_deg: float = 0.01) -> DataFrame:
    """Pairs of slow keys within max_m in one slot, the smaller key first; with before and after of both sides if slots have them."""
    slow = slotted.where(F.col("sog") <= max_sog).select(key, "slot", "latitude", "longitude", "sog", *(c for c in ("before", "after") if c in slotted.columns))
    d = haversine_m(F.col("a.latitude"), F.col("a.longitude"), F.col("b.latitude"), F.col("b.longitude"))
    pairs = proximity_pairs(slow, key, "latitude", "longitude", grid_deg, d <= max_m, ["slot"])
    states = [F.col(f"{side}.{c}").alias(f"{c}_{side}") for c in ("before", "after") if c in slotted.columns for side in ("a", "b")]
    return pairs.select(F.col(f"a.{key}").alias("key_a"), F.col(f"b.{key}").alias("key_b"), F.col("a.slot").alias("slot"), d.alias("separation_m"), F.col("a.sog").alias("sog_a"), F.col("b.sog").alias("sog_b"), ((F.col("a.latitude") + F.col("b.latitude")) / 2).alias("latitude"), ((F.col("a.longitude") + F.col("b.longitude")) / 2).alias("longitude"), *states)


def encounter_episodes(pairs: DataFrame, separation_minutes: float = 60.0, slot_minutes: int = 10) -> DataFrame:
    """Episodes of a pair, split where slots are over an hour apart; the last slot counts in full. Median speed is over both.

    Pairs whose sides have `before` and `after` (`slot_movement`) give approach_a, approach_b,
    departure_a and departure_b as well: before the first slot and after the last.
    """
    order = Window.partitionBy("key_a", "key_b").orderBy("slot")
    gap = boundaries_crossed("minute", F.col("slot"), F.lag("slot").over(order))
    rows = pairs.withColumn("__s", F.when(gap.isNull() | (gap > separation_minutes), 1).otherwise(0)).withColumn("episode", F.sum("__s").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sides = ("a", "b") if "before_a" in pairs.columns else ()
    states = [f(f"{c}_{side}", "slot").alias(f"{name}_{side}") for name, c, f in (("approach", "before", F.min_by), ("departure", "after", F.max_by)) for side in sides]
    listed = {c: F.collect_list(c).alias(f"__{c}") for c in ("latitude", "longitude", "separation_m", "sog_a", "sog_b")}  # one episode's slots
    base = rows.groupBy("key_a", "key_b", "episode").agg(F.min("slot").alias("start_time"), F.max("slot").alias("end_time"), F.count("*").alias("n_slots"), F.max("separation_m").alias("max_separation_m"), *listed.values(), *states)

    def middle(*names):
        v = F.array_sort(F.concat(*(F.col(f"__{n}") for n in names)))
        n = F.size(v)
        at = lambda i: F.get(v, F.floor(i).cast("int")).cast("double")
        return at((n - 1) / 2) + (at(n / 2) - at((n - 1) / 2)) / 2

    hours = (boundaries_crossed("minute", F.col("end_time"), F.col("start_time")) + slot_minutes) / 60
    found = {"latitude": middle("latitude"), "longitude": middle("longitude"), "median_separation_m": middle("separation_m"), "median_sog": middle("sog_a", "sog_b"), "duration_hours": hours}
    return base.withColumns(found).drop(*(f"__{c}" for c in listed))


def structural_gates(episodes: DataFrame, places: DataFrame, min_hours: float = 2.0, max_sog: float = 2.0, max_m: float = 500.0, min_place_m: float = 10_000.0, least_others: int = 5) -> DataFrame:
    """Episodes long, slow and close enough, and far from every anchorage that others than the pair use.

    places have center_latitude, center_longitude and members. Each place lists the coarse cells
    within reach, so that an episode meets the few of its own cell.
    """
    kept = episodes.where((F.col("duration_hours") >= min_hours) & (F.col("median_sog") < max_sog) & (F.col("max_separation_m") <= max_m))
    e = kept.withColumns({"__x": F.floor(F.col("latitude") / 0.25), "__y": F.floor(F.col("longitude") / 0.25)})
    near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    p = places.withColumn("n", F.explode(near)).select("center_latitude", "center_longitude", "members", (F.floor(F.col("center_latitude") / 0.25) + F.col("n.i")).alias("__x"), (F.floor(F.col("center_longitude") / 0.25) + F.col("n.j")).alias("__y"))
    others = F.size(F.array_except("members", F.array("key_a", "key_b")))
    d = haversine_m(F.col("latitude"), F.col("longitude"), F.col("center_latitude"), F.col("center_longitude"))
    close = e.join(p, ["__x", "__y"]).where((d < min_place_m) & (others >= least_others)).select("key_a", "key_b", "episode")
    return kept.join(close, ["key_a", "key_b", "episode"], "left_anti")


def encounter_confidence(approach_a: Column, approach_b: Column, departure_a: Column, departure_b: Column, codrift_m: Column, type_a: Column, type_b: Column, status_a: Column, status_b: Column, anchorage_m: Column, repeats: Column, hours: Column) -> Column:
    """Weighted sum of six scores of an encounter, between 0 and 1.

    approach and departure are each side's movement before and after: moved, stationary or no_data.
    repeats counts the pair's encounters at this place, this one included (`same_place_counts`);
    anchorage_m is the distance to the nearest anchorage, null if none is known. Who reports to be
    moored far from any is as suspicious as who reports to be under way.
    """
    state = lambda m: F.when(m == "moved", 1.0).when(m == "stationary", 0.0).otherwise(0.5)
    either = lambda f: F.coalesce(f(type_a), F.lit(False)) | F.coalesce(f(type_b), F.lit(False))
    both = lambda x, y: (type_a == x) & (type_b == y) | (type_a == y) & (type_b == x)
    kind = F.when(either(lambda t: t.isin(*SERVICE_SHIP_TYPES)), 0.1).when(both("Tanker", "Tanker"), 1.0).when(both("Tanker", "Cargo"), 0.9).when(both("Cargo", "Cargo"), 0.6).when(either(lambda t: t.isin("Tanker", "Cargo")), 0.4).otherwise(0.2)
    offshore = F.coalesce(anchorage_m, F.lit(0.0)) >= ANCHORAGE_M
    status = lambda s: F.when(s.isin(*MOORED), F.when(offshore, 1.0).otherwise(0.0)).when(s.isNull() | s.isin(*UNDEFINED_STATUS), 0.5).otherwise(1.0)
    scores = {
        "rendezvous": (state(approach_a) + state(approach_b) + state(departure_a) + state(departure_b)) / 4,
        "codrift": F.least(F.lit(1.0), codrift_m / CODRIFT_M),
        "ship_type": kind,
        "nav_status": (status(status_a) + status(status_b)) / 2,
        "repetition": F.when(repeats <= 1, 1.0).when(repeats == 2, 0.5).otherwise(0.0),
        "duration": clip((F.lit(LONG_HOURS[1]) - hours) / (LONG_HOURS[1] - LONG_HOURS[0]), 0.0, 1.0),
    }
    return sum((w * scores[k] for k, w in ENCOUNTER_WEIGHTS.items()), F.lit(0.0))


def movement(displacement_m: Column, max_sog: Column, n_slots: Column) -> Column:
    """moved, stationary, or no_data where no slot was heard: missing evidence isn't a vessel at rest."""
    went = (F.coalesce(displacement_m, F.lit(0.0)) >= APPROACH_M) | (F.coalesce(max_sog, F.lit(0.0)) >= TRANSIT_KNOTS)
    return F.when(n_slots == 0, "no_data").when(went, "moved").otherwise("stationary")


def slot_movement(slots: DataFrame, key: str, hours: float = 6.0, slot: str = "slot") -> DataFrame:
    """slots with how the key moved in the hours before each (`before`) and in those after it (`after`)."""
    wide, at = int(hours * 3_600_000_000), micros(F.col(slot))
    out = slots
    place = F.struct("latitude", "longitude")
    for name, order in (("before", at), ("after", -at)):
        frame = Window.partitionBy(key).orderBy(order).rangeBetween(-wide, -1)
        out = out.withColumns({"__first": F.first(place).over(frame), "__last": F.last(place).over(frame), "__sog": F.max("max_sog").over(frame), "__n": F.count(F.lit(1)).over(frame)})
        far = haversine_m(F.col("__first.latitude"), F.col("__first.longitude"), F.col("__last.latitude"), F.col("__last.longitude"))
        out = out.withColumn(name, movement(far, F.col("__sog"), F.col("__n"))).drop("__first", "__last", "__sog", "__n")
    return out


def context_slots(episodes: DataFrame, slots: DataFrame, key: str, hours: float = 6.0, slot: str = "slot") -> DataFrame:
    """Each episode's two sides with their movement before and after: approach_a, approach_b, departure_a, departure_b.

    episodes have key_a, key_b, episode, start_time, end_time; slots are `slots`. A side's slots in
    the hours before the start tell its approach, those after the end its departure. What a key did
    around a time is found once, however many episodes begin or end then. Episodes made from slots
    that have `slot_movement` carry it along and need no join.
    """
    wide = F.expr(f"INTERVAL {int(hours * 3600)} SECONDS")
    ends = {n: f(F.struct("latitude", "longitude"), slot) for n, f in (("__first", F.min_by), ("__last", F.max_by))}
    far = haversine_m(F.col("__first.latitude"), F.col("__first.longitude"), F.col("__last.latitude"), F.col("__last.longitude"))
    out = episodes
    for phase, time in (("approach", "start_time"), ("departure", "end_time")):
        at = F.col("__at")
        lo, hi = (at - wide, at) if phase == "approach" else (at, at + wide)
        sides = [episodes.select(F.col(f"key_{side}").alias(key), F.col(time).alias("__at")) for side in ("a", "b")]
        w = sides[0].unionByName(sides[1]).distinct().withColumns({"__lo": lo, "__hi": hi})
        rows = points_in_intervals(slots, w, key, slot, "__lo", "__hi").where(F.col(slot) != at)
        each = rows.groupBy(key, "__at").agg(F.count("*").alias("__n"), F.max("max_sog").alias("__sog"), *(c.alias(n) for n, c in ends.items())).select(key, "__at", movement(far, F.col("__sog"), F.col("__n")).alias("__state"))
        for side in ("a", "b"):
            out = out.join(each.toDF(f"key_{side}", time, f"{phase}_{side}"), [f"key_{side}", time], "left").fillna("no_data", [f"{phase}_{side}"])
    return out.select(*episodes.columns, "approach_a", "approach_b", "departure_a", "departure_b")


def same_place_counts(episodes: DataFrame, pair: Sequence[str], lat: str, lon: str, radius_m: float = 1_000.0, name: str = "n_same_place") -> DataFrame:
    """episodes with how many of the same pair lie within a radius, each itself included.

    Rows of one place are counted first. Cells are four times as high as the radius, so that a place
    lists one or two each way, further east and west where meridians lie close.
    """
    size = radius_m / 110_000.0
    cell = lambda c: F.floor(c / (4 * size))
    own = written(episodes, "episodes")
    places = own.groupBy(*pair, F.col(lat).cast("double").alias("__lat"), F.col(lon).cast("double").alias("__lon")).agg(F.count("*").alias("__n"))
    a = places.select(*pair, F.col("__lat").alias("__la"), F.col("__lon").alias("__lo"), cell(F.col("__lat")).alias("__y"), cell(F.col("__lon")).alias("__x"))
    wide = size / F.greatest(F.cos(F.radians(F.least(F.abs("__lat") + size, F.lit(89.0)))), F.lit(0.02))
    b = places.withColumn("__x", F.explode(F.sequence(cell(F.col("__lon") - wide), cell(F.col("__lon") + wide)))).withColumn("__y", F.explode(F.sequence(cell(F.col("__lat") - size), cell(F.col("__lat") + size))))
    # listed rows are more than Spark's estimate lets it see: no side may be sent to all tasks
    near = a.join(b.hint("merge"), [*pair, "__x", "__y"]).where(haversine_m(F.col("__la"), F.col("__lo"), F.col("__lat"), F.col("__lon")) <= radius_m)
    counts = near.groupBy(*pair, "__la", "__lo").agg(F.sum("__n").alias(name))
    keyed = own.withColumns({"__la": F.col(lat).cast("double"), "__lo": F.col(lon).cast("double")})
    return keyed.join(counts, [*pair, "__la", "__lo"]).select(*episodes.columns, name)


def agreement(ours: DataFrame, theirs: DataFrame, tolerance_minutes: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """Both sides with `matched`: an encounter of the same two keys that overlaps, with both widened by the tolerance.

    Both have id, key_a, key_b (any order), start_time, end_time.
    """
    side = lambda d: d.withColumns({"__lo": F.least("key_a", "key_b"), "__hi": F.greatest("key_a", "key_b")})
    met = lambda a, b: that_overlap(side(a), side(b), ["__lo", "__hi"], "start_time", "end_time", tolerance_minutes * 60).select("id").distinct()
    flag = lambda d, other: d.join(met(d, other).withColumn("matched", F.lit(True)), "id", "left").fillna(False, ["matched"])
    return flag(ours, theirs), flag(theirs, ours)


def no_valid_imo(static: DataFrame, key: str, ts: str, imo: str, ship_type: str, least_messages: int = 20, least_days: float = 3.0) -> DataFrame:
    """Tankers and cargo ships that sent many static messages over days, and never a valid number."""
    out = static.groupBy(key).agg(F.count("*").alias("n_messages"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.bool_or(valid_imo(F.col(imo))).alias("__valid"), F.bool_or(F.col(ship_type).isin("Tanker", "Cargo")).alias("__due"))
    days = seconds_between(F.col("last_seen"), F.col("first_seen")) / 86400
    return out.where(F.col("__due") & ~F.col("__valid") & (F.col("n_messages") >= least_messages) & (days >= least_days)).drop("__valid", "__due")


def reused_keys(static: DataFrame, key: str, ts: str, imo: str) -> DataFrame:
    """Keys with several valid numbers, dated when the second appears."""
    firsts = static.where(valid_imo(F.col(imo))).groupBy(key, imo).agg(F.min(ts).alias("t"))
    out = firsts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t", imo))).alias("v")).where("size(v) > 1")
    return out.select(key, F.get("v", F.lit(1)).getField("t").alias("event_time"), F.transform("v", lambda x: x[imo]).alias("imos"))


def course_mismatch(trips: DataFrame, positions: DataFrame, ports: DataFrame, key: str, ts: str, lat: str, lon: str, cog: str, sog: str, destination: str, least: int = 10, min_sog: float = 2.0, min_m: float = 20_000.0, min_deg: float = 90.0) -> DataFrame:
    """Trips that declare one port, known by a unique name, and for most of the way head elsewhere.

    ports have name, port_lat, port_lon; names that two ports share match nothing.
    """
    inside = points_in_intervals(positions, trips.select(key, "voyage_id", "start_time", "end_time"), key, ts, "start_time", "end_time").withColumn("__d", normal_text(F.col(destination)))
    said = inside.where(known_text(F.col("__d"))).groupBy("voyage_id", "__d").agg(F.count("*").alias("n"))
    modal = said.groupBy("voyage_id").agg(F.min_by("__d", F.struct(-F.col("n"), "__d")).alias("__d"))
    named = ports.withColumn("__d", normal_text(F.col("name"))).groupBy("__d").agg(F.count("*").alias("n"), F.first("port_lat").alias("port_lat"), F.first("port_lon").alias("port_lon")).where("n = 1").drop("n")
    rows = inside.drop("__d").join(modal.join(named, "__d"), "voyage_id").where((F.col(sog) >= min_sog) & F.col(cog).isNotNull() & (F.col(cog) < 360))
    away = haversine_m(F.col(lat), F.col(lon), F.col("port_lat"), F.col("port_lon"))
    off = angle_between(F.col(cog), bearing_deg(F.col(lat), F.col(lon), F.col("port_lat"), F.col("port_lon")))
    out = rows.where(away >= min_m).groupBy(key, "voyage_id").agg(F.count("*").alias("n_samples"), F.median(off).alias("median_angle"), F.first("__d").alias("destination"), F.max("end_time").alias("end_time"))
    return out.where((F.col("n_samples") >= least) & (F.col("median_angle") >= min_deg))


def draught_changes(trips: DataFrame, positions: DataFrame, key: str, ts: str, draught: str, least: int = 3, min_m: float = 2.0) -> DataFrame:
    """Consecutive trips of a key whose median draughts differ by min_m or more; the change is positive if deeper."""
    inside = points_in_intervals(positions.where(F.col(draught) > 0), trips.select(key, "voyage_id", "start_time", "end_time"), key, ts, "start_time", "end_time")
    mid = inside.groupBy(key, "voyage_id", "start_time", "end_time").agg(F.count("*").alias("n"), F.median(draught).alias("draught")).where(F.col("n") >= least)
    order = Window.partitionBy(key).orderBy("start_time")
    rows = mid.withColumns({"prev_voyage_id": F.lag("voyage_id").over(order), "change_m": F.col("draught") - F.lag("draught").over(order), "prev_end_time": F.lag("end_time").over(order)})
    return rows.where(F.abs("change_m") >= min_m).select(key, "prev_voyage_id", "voyage_id", "prev_end_time", F.col("start_time").alias("event_time"), "change_m")


def unexplained_draught_changes(
    trips: DataFrame, positions: DataFrame, places: DataFrame, encounters: DataFrame, key: str, ts: str, draught: str, least: int = 3, min_m: float = 2.0,
    full_m: float = 5.0, radius_m: float = 10_000.0, least_others: int = 5,
) -> DataFrame:
    """Changes of median draught from a trip to the very next one that neither an anchorage nor an encounter explains.

    trips have voyage_id, start_time, end_time and the latitude and longitude of both ends. A change is
    explained where either end of the silence lies within a radius of an anchorage that stays one
    without the vessel itself, or an encounter overlaps the silence. Trips with under `least` readings have no
    draught, and are no neighbours of any. Confidence is full from a change of full_m on. places are the anchorages that
    may be known (coastal ones, of windows that have ended).
    """
    inside = points_in_intervals(positions.where(F.col(draught) > 0), trips.select(key, "voyage_id", "start_time", "end_time"), key, ts, "start_time", "end_time")
    mid = inside.groupBy("voyage_id").agg(F.count("*").alias("n"), F.median(draught).alias("median_draught")).where(F.col("n") >= least).select("voyage_id", "median_draught")
    order = Window.partitionBy(key).orderBy("start_time", "voyage_id")
    ahead = {f"next_{c}": F.lead(c).over(order) for c in ("voyage_id", "start_time", "start_latitude", "start_longitude")}
    pairs = trips.withColumns(ahead).where(F.col("next_voyage_id").isNotNull())
    after = mid.select(F.col("voyage_id").alias("next_voyage_id"), F.col("median_draught").alias("new_draught"))
    changes = pairs.join(mid.withColumnRenamed("median_draught", "old_draught"), "voyage_id").join(after, "next_voyage_id").withColumn("change_m", F.col("new_draught") - F.col("old_draught")).where(F.abs("change_m") >= min_m)
    ends = F.explode(F.array(*(F.struct(F.lit(side).alias("side"), F.col(y).alias("y"), F.col(x).alias("x")) for side, y, x in ((0, "end_latitude", "end_longitude"), (1, "next_start_latitude", "next_start_longitude")))))
    points = changes.select(key, "voyage_id", ends.alias("e")).select(key, "voyage_id", F.struct("voyage_id", "e.side").alias("point"), "e.y", "e.x")
    moored = near_anchorage(points, places, "point", key, "y", "x", radius_m, least_others).select("voyage_id").distinct()
    met = during_encounter(changes.select("voyage_id", key, "end_time", "next_start_time"), encounters, "voyage_id", key, "end_time", "next_start_time").select("voyage_id")
    left = changes.join(moored, "voyage_id", "left_anti").join(met, "voyage_id", "left_anti")
    return left.select(key, "voyage_id", "next_voyage_id", F.col("end_time").alias("event_time"), F.col("end_latitude").alias("latitude"), F.col("end_longitude").alias("longitude"), "old_draught", "new_draught", "change_m", F.least(F.abs("change_m") / full_m, F.lit(1.0)).alias("confidence"))


def fleet_dossiers(presence: DataFrame, identity: DataFrame, sanctions: DataFrame, events: DataFrame, key: str = "mmsi") -> DataFrame:
    """A row for each sanctioned vessel that was heard, by its number or else its key: when, under which keys and flags, and what it did.

    identity has key, imo, flag and name; sanctions imo, source and designation_date; events key and
    kind. Keys go by hours heard, flags by when they were first heard; lead_days are those from the
    first day heard to the earliest designation, positive if it came after.
    """
    ids = identity.groupBy(key).agg(F.max("imo").alias("imo"), F.max("flag").alias("flag"), F.max("name").alias("name"))
    listed = sanctions.where(F.col("imo").isNotNull()).groupBy("imo").agg(F.min("designation_date").alias("designated"), F.array_sort(F.collect_set(F.struct("designation_date", "source"))).alias("designations"))
    seen = presence.groupBy(key).agg(F.count_distinct("cell_hour").alias("hours"), F.min(F.col("cell_hour").cast("date")).alias("first"), F.max(F.col("cell_hour").cast("date")).alias("last"))
    did = events.groupBy(key).agg(F.count("*").alias("n_events"))
    each = ids.join(listed, "imo").join(seen, key).join(did, key, "left")
    days = presence.join(ids.select(key, "imo"), key).groupBy("imo").agg(F.count_distinct(F.col("cell_hour").cast("date")).alias("n_days"))
    by_hours, by_time = F.array_sort(F.collect_list(F.struct((-F.col("hours")).alias("h"), F.col(key).alias("k")))), F.array_sort(F.collect_list(F.struct("first", "flag")))
    out = each.groupBy("imo", "designated", "designations").agg(by_hours.alias("keys"), by_time.alias("flags"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("hours").alias("hours"), F.sum(F.coalesce("n_events", F.lit(0))).alias("n_events"), F.min_by("name", F.struct(-F.col("hours"), key)).alias("name"))
    told = F.array_distinct(F.filter(F.transform("flags", lambda x: x.flag), lambda x: x.isNotNull()))
    return out.join(days, "imo").select("imo", "name", F.transform("keys", lambda x: x.k).alias(f"{key}s"), told.alias("flags"), "first", "last", "n_days", "hours", "n_events", "designated", F.transform("designations", lambda x: F.concat_ws(" ", x.designation_date, x.source)).alias("designations"), F.date_diff("designated", "first").alias("lead_days"))


def gate_crossings(df: DataFrame, key: str, ts: str, lat: str, lon: str, gate: float = 14.0, lat_low: float = 54.3, lat_high: float = 56.0, max_hours: float = 2.0) -> DataFrame:
    """Consecutive positions on both sides of a meridian, at most max_hours apart: E for eastward, W for westward."""
    p = pair_with_previous(df.where(F.col(lat).between(lat_low, lat_high)), [key], ts, [lon])
    east, west = (F.col(f"prev_{lon}") < gate) & (F.col(lon) >= gate), (F.col(f"prev_{lon}") >= gate) & (F.col(lon) < gate)
    near = seconds_between(F.col(ts), F.col(f"prev_{ts}")) <= max_hours * 3600
    return p.where(near & (east | west)).select(key, F.col(ts).alias("crossing_time"), F.when(east, "E").otherwise("W").alias("direction"))


def round_trips(crossings: DataFrame, key: str, min_days: int = 2, max_days: int = 30) -> DataFrame:
    """Each eastward crossing with the first westward one after it, if the days between are in range."""
    out = next_event(crossings, [key], "crossing_time", F.col("direction") == "E", F.col("direction") == "W", [])
    days = boundaries_crossed("day", F.col("next_crossing_time"), F.col("crossing_time"))
    return out.select(key, F.col("crossing_time").alias("east_time"), F.col("next_crossing_time").alias("west_time"), days.alias("days")).where(F.col("days").between(min_days, max_days))


def trip_draughts(trips: DataFrame, readings: DataFrame, key: str, ts: str, draught: str, window_hours: float = 12.0) -> DataFrame:
    """Median draught within window_hours of both crossings, the largest of all readings before the westward one, and the change relative to it.

    What no reading tells is null, and so is the change where the largest isn't above 0.
    """
    hours = F.expr(f"INTERVAL {int(window_hours * 3600)} SECONDS")
    out = trips
    for end in ("east", "west"):
        t = trips.select(key, "east_time", "west_time", (F.col(f"{end}_time") - hours).alias("__from"), (F.col(f"{end}_time") + hours).alias("__to")).distinct()
        rows = points_in_intervals(readings.select(key, ts, draught), t, key, ts, "__from", "__to")
        out = out.join(rows.groupBy(key, "east_time", "west_time").agg(F.median(draught).alias(f"draught_{end}")), [key, "east_time", "west_time"], "left")
    # a running maximum of the key's readings, each trip taking what came strictly before it
    value = F.col(draught).cast("double")
    sequence = readings.select(key, F.col(ts).alias("__t"), value.alias("__v")).unionByName(trips.select(key, F.col("west_time").alias("__t")), allowMissingColumns=True)
    so_far = Window.partitionBy(key).orderBy(micros(F.col("__t"))).rangeBetween(Window.unboundedPreceding, -1)
    most = sequence.withColumn("draught_max", F.max("__v").over(so_far)).groupBy(key, F.col("__t").alias("west_time")).agg(F.max("draught_max").alias("draught_max"))
    out = out.join(most, [key, "west_time"], "left")
    change = F.when(F.col("draught_max") > 0, (F.col("draught_west") - F.col("draught_east")) / F.col("draught_max"))
    return out.withColumn("rel_change", change)


def attach_trips(positions: DataFrame, trips: DataFrame, key: str, ts: str) -> DataFrame:
    """Positions with the trip that most recently began, by as-of join; earlier positions go."""
    return asof_join(positions, trips, [key], ts, "start_time", ["voyage_id"]).drop("asof_start_time").withColumnRenamed("asof_voyage_id", "voyage_id")


def tracks(df: DataFrame, key: str, ts: str, lat: str, lon: str, max_gap_minutes: float = 60.0, jump_seconds: float = 300.0, max_knots: float = 40.0) -> DataFrame:
    """Numbers each key's trips for drawing: a new one after a long gap, or after a slow jump too fast to be real."""
    order = Window.partitionBy(key).orderBy(ts)
    s = seconds_between(F.col(ts), F.lag(ts).over(order))
    v = haversine_m(F.lag(lat).over(order), F.lag(lon).over(order), F.col(lat), F.col(lon)) / F.nullif(s, F.lit(0.0)) / KNOT_M_PER_S
    cut = F.when(s.isNull() | (s > max_gap_minutes * 60) | ((s >= jump_seconds) & (v > max_knots)), 1).otherwise(0)
    return df.withColumn("__c", cut).withColumn("trip", F.sum("__c").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__c")


def vessel_density(df: DataFrame, key: str, lat: str, lon: str, zoom_deg: float) -> DataFrame:
    """Distinct keys per pixel of a Web Mercator raster."""
    from tidemark.functions.columns import web_mercator_y

    px, py = F.floor(F.col(lon) / zoom_deg).alias("px"), F.floor(F.degrees(web_mercator_y(F.col(lat))) / zoom_deg).alias("py")
    return df.groupBy(px, py).agg(F.count_distinct(key).alias("n_vessels"))



def near_anchorage(positions: DataFrame, places: DataFrame, row_id: str, key: str, lat: str, lon: str, radius_m: float, least_others: int = 5) -> DataFrame:
    """Rows of positions within a radius of an anchorage that stays one without the row's own key.

    places have center_latitude, center_longitude and members; each lists the cells within reach.
    """
    size = radius_m / 110_000.0
    wide = F.ceil(1 / F.greatest(F.cos(F.radians(F.least(F.abs("center_latitude") + size, F.lit(89.0)))), F.lit(0.02))).cast("long")
    y, x = F.floor(F.col("center_latitude") / size), F.floor(F.col("center_longitude") / size)
    p = places.select("center_latitude", "center_longitude", "members", F.explode(F.sequence(x - wide, x + wide)).alias("__x"), y.alias("__y0")).withColumn("__y", F.explode(F.sequence(F.col("__y0") - 1, F.col("__y0") + 1)))
    at = positions.withColumns({"__y": F.floor(F.col(lat) / size), "__x": F.floor(F.col(lon) / size)})
    others = F.size("members") - F.when(F.array_contains("members", F.col(key)), 1).otherwise(0)
    close = haversine_m(F.col(lat), F.col(lon), F.col("center_latitude"), F.col("center_longitude")) <= radius_m
    found = at.join(p, ["__x", "__y"]).where(close & (others >= least_others)).select(row_id).distinct()
    return positions.join(found, row_id, "left_semi")


def during_encounter(gaps: DataFrame, encounters: DataFrame, row_id: str, key: str, start: str, end: str) -> DataFrame:
    """Rows of gaps that an encounter with their key on either side overlaps, touching included.

    Encounters (key_a, key_b, start_time, end_time) are listed under both of their keys.
    """
    sides = encounters.select(F.explode(F.array("key_a", "key_b")).alias(key), F.col("start_time").alias(start), F.col("end_time").alias(end))
    met = that_overlap(gaps.select(row_id, key, start, end), sides, [key], start, end)
    return gaps.join(met.select(row_id).distinct(), row_id, "left_semi")


def shares_that_overlap(ours: DataFrame, theirs: DataFrame, key: str, start: str, end: str, sample: int, seed: int = 0) -> DataFrame:
    """One row: of a seeded sample of ours, how many rows overlap one of theirs with the same key, and the share.

    The sample is the rows with the smallest digests of seed and row, so it is the same anywhere.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in (key, start, end))).cast("binary"))
    chosen = ours.withColumn("__d", digest).orderBy("__d").limit(sample)
    met = overlapping_pairs(chosen, theirs, [key], start, end).select(F.col("l.__d").alias("__d")).distinct().withColumn("__hit", F.lit(1))
    return chosen.join(met, "__d", "left").agg(F.count("*").alias("n_sampled"), F.count("__hit").alias("n_overlapping"), F.avg(F.coalesce("__hit", F.lit(0))).alias("share"))


def laden_threshold(trips: DataFrame, change: str, bins: int = 60, smooth: int = 5, least: int = 30, fallback: float = 0.2) -> float:
    """The valley between the two highest peaks of a smoothed histogram of changes; the fallback without enough trips or peaks.

    Bins are counted on the cluster; a count for each bin reaches the driver. Changes that are null,
    NaN or infinite, as from a draught of zero, are none.
    """
    values = trips.select(F.col(change).cast("double").alias("v")).where(~F.isnan("v") & (F.abs("v") < float("inf")))
    whole = values.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    if whole.n < least or whole.low == whole.high:
        return fallback
    width = (whole.high - whole.low) / bins
    found = {r.b: r["count"] for r in values.groupBy(F.least(F.floor((F.col("v") - whole.low) / width), F.lit(bins - 1)).alias("b")).count().collect()}
    counts, half = [found.get(i, 0) for i in range(bins)], smooth // 2
    height = [sum(counts[max(i - half, 0) : i + half + 1]) for i in range(bins)]
    edge = lambda i: height[i] if 0 <= i < bins else -1
    peaks = sorted((i for i in range(bins) if height[i] and edge(i - 1) < height[i] > edge(i + 1)), key=lambda i: (-height[i], i))[:2]
    if len(peaks) < 2:
        return fallback
    valley = min(range(min(peaks), max(peaks) + 1), key=lambda i: (height[i], i))
    return whole.low + (valley + 0.5) * width
