"""Constrained subset selection: quotas from counts, rows by a seeded hash rank, and an exact solver for percentage caps.

Counts of categories, a bounded table, go to the driver; which rows stay is decided in Spark by rank within a category.
Ranks within one category come from with_rank(), which numbers rows by hash range instead of sorting a category in one task.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.order import with_position

#: Hash ranges per category.
RANGES = 64


def token(seed: int, id_col: str) -> Column:
    return F.sha1(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def with_rank(df: DataFrame, keys: list[str], id_col: str, seed: int, out: str = "rank") -> DataFrame:
    """df with each row's rank (from 1) within its keys in the order of its token.

    Tokens are hex digits, so their first two give ranges of equal size: ranks in each range, plus the sizes of those before.
    """
    own = df.withColumn("__t", token(seed, id_col)).withColumn("__r", F.floor(F.conv(F.substring("__t", 1, 2), 16, 10).cast("int") / (256 // RANGES)))
    inner = F.row_number().over(Window.partitionBy(*keys, "__r").orderBy("__t", id_col))
    sizes = own.groupBy(*keys, "__r").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__b", F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return own.withColumn("__i", inner).join(before, [*keys, "__r"]).withColumn(out, F.col("__b") + F.col("__i")).drop("__t", "__r", "__i", "__b")


def take_quotas(df: DataFrame, keys: list[str], quotas: dict, id_col: str, seed: int, rest: bool = False) -> DataFrame:
    """The first quota rows of each category by rank; rows of categories without a quota stay only with rest."""
    name = F.concat_ws("\x01", *keys)
    limit = F.coalesce(*[F.when(name == "\x01".join(k if isinstance(k, tuple) else (k,)), F.lit(n)) for k, n in quotas.items()], F.lit(-1))
    ranked = with_rank(df, keys, id_col, seed).withColumn("__q", limit)
    return ranked.where((F.col("rank") <= F.col("__q")) | (F.lit(rest) & (F.col("__q") < 0))).drop("__q", "rank")


def counts_of(df: DataFrame, *keys: str) -> dict:
    rows = df.groupBy(*keys).count().collect()
    return {(tuple(r[:-1]) if len(keys) > 1 else r[0]): r[-1] for r in rows}


def min_share_quotas(counts: dict[str, int], shares: dict[str, float]) -> dict[str, int]:
    """Quotas that meet least shares (percent): the largest total they allow, trimmed where a category has most to spare.

    Shares of absent categories don't count; shares that sum to more than 100 change nothing.
    """
    own = {c: Fraction(str(p)) for c, p in shares.items() if counts.get(c) and p > 0}
    n = sum(counts.values())
    if not own or sum(own.values()) > 100:
        return dict(counts)
    target = min(n, *(int(counts[c] * 100 / p) for c, p in own.items()))
    need = {c: math.ceil(target * own.get(c, 0) / 100) for c in counts}
    left, out = n - target, dict(counts)
    order = {c: k for k, c in enumerate(sorted(counts))}
    while left > 0:
        spare = [c for c in counts if out[c] > need[c]]
        if not spare:
            break
        best = max(spare, key=lambda c: (out[c] - need[c], out[c], -order[c]))
        second = max((out[c] - need[c] for c in spare if c != best), default=0)
        step = max(1, min(left, out[best] - need[best] - second))
        out[best] -= step
        left -= step
    return out


def equalized(counts: dict[str, int], families: list[str]) -> dict[str, int]:
    """As many of each listed family as the smallest that is there has; others none."""
    there = [counts[f] for f in families if counts.get(f)]
    return {f: min(there) for f in families if counts.get(f)} if there else {}


def min_family_quotas(counts: dict[str, int], families: list[str], pct: float) -> dict[str, int]:
    """The largest total of which each listed family can make pct percent; families that aren't listed are trimmed first."""
    p = Fraction(str(pct))
    own = [f for f in families if counts.get(f)]
    n = sum(counts.values())
    total = min([n, *(int(counts[f] * 100 / p) for f in own)])
    need, left, out = math.ceil(total * p / 100), n - total, dict(counts)
    for group in ([c for c in sorted(counts) if c not in own], own):
        for c in sorted(group, key=lambda c: (-counts[c], c)):
            cut = min(left, max(0, out[c] - (need if c in own else 0)))
            out[c] -= cut
            left -= cut
    return out


def joint_quotas(counts: dict[tuple[str, str], int], families: list[str], scope: str, pct: float) -> dict[tuple[str, str], int]:
    """Equal families with a least share of one scope over all: the largest equal target per family, found by bisection.

    Within a family rows of the scope are forced where others don't suffice; what is still missing goes to families with
    most of the scope left.
    """
    p = Fraction(str(pct))
    size = {f: sum(n for (g, _), n in counts.items() if g == f) for f in families}
    own = {f: counts.get((f, scope), 0) for f in families}
    fits = lambda t: sum(min(own[f], t) for f in families) * 100 >= p * t * len(families)
    low, high = 0, min(size.values(), default=0)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if fits(mid) else (low, mid - 1)
    take = {f: max(0, low - (size[f] - own[f])) for f in families}
    missing = math.ceil(p * low * len(families) / 100) - sum(take.values())
    for f in sorted(families, key=lambda f: (-(min(own[f], low) - take[f]), f)):
        more = min(max(0, missing), min(own[f], low) - take[f])
        take[f] += more
        missing -= more
    out = {}
    for f in families:
        out[f, scope], rest = take[f], low - take[f]
        for g, s in sorted(k for k in counts if k[0] == f and k[1] != scope):
            out[g, s] = min(rest, counts[g, s])
            rest -= out[g, s]
    return out


def projected_size(counts: dict[str, int], families: list[str], pct: float | None = None) -> int:
    return sum((equalized(counts, families) if pct is None else min_family_quotas(counts, families, pct)).values())


def _cap(total: int, pct: Fraction) -> int:
    return max(int(total * pct / 100), 1)


def _flow(classes: list[tuple[tuple[frozenset, ...], int]], caps: list[Fraction | None], total: int) -> list[int] | None:
    """Rows per class that reach a total with two single-valued fields, or null: a flow from values of one to values of the other."""
    ends = [[next(iter(s)) for s in sets] for sets, _ in classes]
    room = [{e[f]: total if caps[f] is None else _cap(total, caps[f]) for e in ends} for f in (0, 1)]
    used, out = [dict.fromkeys(r, 0) for r in room], [0] * len(classes)
    while sum(out) < total:
        # the shortest way from a left value with room to a right value with room, forward over spare rows, back over used ones
        back: dict[tuple[int, str], tuple | None] = {(0, v): None for v in room[0] if used[0][v] < room[0][v]}
        queue, goal = list(back), None
        for side, v in queue:
            if side == 1 and used[1][v] < room[1][v]:
                goal = (side, v)
                break
            for k, e in enumerate(ends):
                nxt = (1 - side, e[1 - side])
                if e[side] == v and nxt not in back and (out[k] < classes[k][1] if side == 0 else out[k] > 0):
                    back[nxt] = ((side, v), k, 1 if side == 0 else -1)
                    queue.append(nxt)
        if goal is None:
            return None
        path, at = [], goal
        while back[at] is not None:
            at, k, sign = back[at]
            path.append((k, sign))
        step = min(total - sum(out), room[0][at[1]] - used[0][at[1]], room[1][goal[1]] - used[1][goal[1]], *(classes[k][1] - out[k] if sign > 0 else out[k] for k, sign in path))
        for k, sign in path:
            out[k] += sign * step
        used[0][at[1]] += step
        used[1][goal[1]] += step
    return out


def _search(classes: list[tuple[tuple[frozenset, ...], int]], caps: list[Fraction | None], shares: list[tuple[int, str, Fraction]], total: int, steps: int) -> list[int] | None:
    """Rows per class that reach a total, by depth-first search; null if there are none; raises TimeoutError after so many steps."""
    order = sorted(range(len(classes)), key=lambda k: (sum(len(s) for s in classes[k][0]), -classes[k][1]))
    left = {(f, v): _cap(total, c) for f, c in enumerate(caps) if c is not None for sets, _ in classes for v in sets[f]}
    need = [math.ceil(p * total / 100) for _, _, p in shares]
    holds = [[k for k, (f, v, _) in enumerate(shares) if v in classes[i][0][f]] for i in order]
    rest = [sum(classes[i][1] for i in order[j:]) for j in range(len(order) + 1)]
    share_rest = [[sum(classes[i][1] for i, h in zip(order[j:], holds[j:], strict=True) if k in h) for j in range(len(order) + 1)] for k in range(len(shares))]
    out = [0] * len(classes)

    def go(j: int, missing: int) -> bool:
        if missing > rest[j] or any(need[k] > share_rest[k][j] for k in range(len(shares))):
            return False
        if j == len(order):
            return missing == 0
        nonlocal steps
        steps -= 1
        if steps < 0:
            raise TimeoutError
        sets, n = classes[order[j]]
        own = [x for x in ((f, v) for f, s in enumerate(sets) for v in s) if x in left]
        for take in range(min([n, missing, *(left[x] for x in own)]), max(0, missing - rest[j + 1]) - 1, -1):
            for x in own:
                left[x] -= take
            for k in holds[j]:
                need[k] -= take
            out[order[j]] = take
            if go(j + 1, missing - take):
                return True
            for x in own:
                left[x] += take
            for k in holds[j]:
                need[k] += take
        return False

    return out if go(0, total) else None


def solve_caps(classes: list[tuple[tuple[frozenset, ...], int]], caps: list[float | None], shares: list[tuple[int, str, float]] = (), most: int | None = None, steps: int = 3_000_000) -> tuple[list[int], str]:
    """How many rows of each class to keep: the most rows so that every category keeps within its cap and reaches its share.

    classes: (a set of categories for each field, rows). A cap of p percent at a total of T allows max(floor(T p / 100), 1).
    Totals are tried from an upper bound down, as feasibility is not monotone with shares. Two single-valued fields
    without shares are a flow problem, solved exactly. Otherwise a depth-first search decides each total, in so many steps
    at most, so results don't depend on a clock. If it gave up on a total above the one it found, the status is "feasible",
    else "optimal".
    """
    cap = [None if c is None else Fraction(str(c)) for c in caps]
    want = [(f, v, Fraction(str(p))) for f, v, p in shares]
    single = [all(len(sets[f]) == 1 for sets, _ in classes) for f in range(len(cap))]
    sizes = [dict() for _ in cap]
    for sets, n in classes:
        for f, s in enumerate(sets):
            for v in s:
                sizes[f][v] = sizes[f].get(v, 0) + n
    bound = min(sum(n for _, n in classes), most if most is not None else sum(n for _, n in classes))

    def fits(total: int) -> bool:
        return all(c is None or not single[f] or sum(min(n, _cap(total, c)) for n in sizes[f].values()) >= total for f, c in enumerate(cap))

    flow = len(cap) == 2 and all(single) and not want
    proven = True
    for total in range(bound, 0, -1):
        if fits(total):
            try:
                found = _flow(classes, cap, total) if flow else _search(classes, cap, want, total, steps if proven else steps // 100)
            except TimeoutError:
                found, proven = None, False
            if found is not None:
                return found, "optimal" if proven else "feasible"
    raise ValueError("no subset meets the caps and shares")


def exact_caps(df: DataFrame, fields: dict[str, Column], caps: dict[str, float], id_col: str, shares: list[tuple[str, str, float]] = (), seed: int = 42, steps: int = 3_000_000) -> DataFrame:
    """The rows of a largest subset within the caps, with cap_status (optimal or feasible): rows with equal categories form classes, classes are solved, rows drawn by rank."""
    names = list(fields)
    keyed = df.withColumns({f"__{n}": F.array_join(F.array_sort(fields[n]), "\x02") for n in names})
    keys = [f"__{n}" for n in names]
    found = sorted(tuple(r) for r in keyed.groupBy(*keys).count().collect())
    classes = [(tuple(frozenset(v.split("\x02")) for v in r[:-1]), r[-1]) for r in found]
    counts, status = solve_caps(classes, [caps.get(n) for n in names], [(names.index(f), v, p) for f, v, p in shares], steps=steps)
    quotas = df.sparkSession.createDataFrame([(*r[:-1], n) for r, n in zip(found, counts, strict=True)], ", ".join(f"{k} string" for k in keys) + ", __q long")
    ranked = with_rank(keyed, keys, id_col, seed).join(F.broadcast(quotas), keys)
    return ranked.where("rank <= __q").drop(*keys, "rank", "__q").withColumn("cap_status", F.lit(status))


def weighted_order(weight: Column, key: Column, seed: int = 42) -> Column:
    """Order key of weighted sampling without replacement: the first k rows by it, descending, are a sample of k."""
    return F.ln(uniform(key, seed)) / weight


def uniform(key: Column, seed: int) -> Column:
    """A number between 0 and 1 that follows from key and seed."""
    return (F.conv(F.substring(F.sha1(F.concat(F.lit(f"{seed}:"), key)), 1, 12), 16, 10).cast("double") + 1) / F.lit(float(16**12 + 1))


def draw_names(bank: DataFrame, draws: int, alpha: float, penalty: float, seed: int = 42) -> DataFrame:
    """place (from 1), name, soft: so many weighted draws from a bank of name, frequency, used (how often it was drawn before).

    Unused names go first, each once, by weights of frequency ** alpha. Then all names are drawn again, softly, by
    frequency ** alpha / (1 + penalty * times used) ** 2. A weight depends on its own name's uses only, so draws one after
    the other are a race: a name's next draw comes after an exponential time of its weight, and the earliest ones are
    drawn. Draws of a name are made in advance, and twice as many if one runs out. Rows of one name count as one
    with the sum of their weights and the most uses; null names and frequencies that aren't positive are never drawn.
    """
    names = bank.where("name is not null and frequency > 0").groupBy("name").agg(F.sum(F.pow(F.col("frequency").cast("double"), alpha)).alias("w"), F.coalesce(F.max("used"), F.lit(0)).alias("used"))
    fresh = names.where("used <= 0").select("name", F.lit(False).alias("soft"), F.lit(0).alias("k"), (-weighted_order(F.col("w"), F.concat(F.lit("0:"), "name"), seed)).alias("at"))
    more = draws - fresh.count()
    ahead = min(4, more + 1)
    while True:
        found = fresh
        if more > 0:
            weight = F.col("w") / F.pow(1 + penalty * (F.greatest("used", F.lit(1)) + F.col("k") - 1), F.lit(2))
            waits = names.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(ahead)))).withColumn("wait", -weighted_order(weight, F.concat(F.col("k").cast("string"), F.lit(":"), "name"), seed))
            found = fresh.union(waits.select("name", F.lit(True), "k", F.sum("wait").over(Window.partitionBy("name").orderBy("k"))))
        drawn = found.orderBy("soft", "at", "name").limit(draws)
        if more <= 0 or ahead > more or (drawn.agg(F.max("k")).first()[0] or 0) < ahead:
            return with_position(drawn, [F.col("soft"), F.col("at"), F.col("name")], "place").select((F.col("place") + 1).alias("place"), "name", "soft")
        ahead = min(2 * ahead, more + 1)


def excess_names(df: DataFrame, name: str, id_col: str, most: int, listed: list[str], seed: int = 42) -> DataFrame:
    """Rows beyond the first so many, by rank, of each listed surname: the ones to rename."""
    own = df.where(F.lower(name).isin(listed)).withColumn("__k", F.lower(name))
    return with_rank(own, ["__k"], id_col, seed).where(F.col("rank") > most).drop("__k", "rank")
