"""Greedy choices. The loop is over the few picks, each pick one distributed aggregate; only the pick itself comes back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def covering(profile: DataFrame, key: str, labels: list[str], picks: int) -> list[tuple]:
    """``picks`` keys chosen one after another: each adds most to the labels that are rarest so far, weighing a label by 1/(1 + what it has).

    ``profile``: key and a count column a label. Ties go to the smaller key. Returns (key, gain) in order.
    """
    have, chosen = dict.fromkeys(labels, 0), []
    for _ in range(picks):
        gain = sum((F.col(c) / (1.0 + have[c]) for c in labels), F.lit(0.0))
        rest = profile.where(~F.col(key).isin([k for k, _ in chosen])) if chosen else profile
        best = rest.select(key, F.round(gain, 9).alias("gain"), *labels).orderBy(F.desc("gain"), key).limit(1).collect()
        if not best:
            break
        for c in labels:
            have[c] += best[0][c]
        chosen.append((best[0][key], best[0]["gain"]))
    return chosen


def adopted(rows: DataFrame, tags: list[int], candidates: dict[int, float], least: float = 5e-4) -> list[tuple[int, float, float]]:
    """Thresholds adopted one tag at a time while macro F1 gains ``least`` or more: (tag, threshold, f1 after).

    ``rows``: gold and p (probabilities by tag). Under a threshold a tag can't be chosen; the best tag that may be is. If
    none may, the first tag is.
    """

    def f1(limits: dict[int, float]) -> float:
        allowed = F.transform("p", lambda x, i: F.when(x >= F.coalesce(F.try_element_at(F.create_map(*[v for t in tags for v in (F.lit(t), F.lit(limits.get(t, 0.0)))]), i), F.lit(0.0)), x).otherwise(F.lit(-1.0)))
        top = F.array_max(allowed)
        pred = F.when(top < 0, F.lit(tags[0])).otherwise((F.array_position(allowed, top) - 1).cast("int"))
        counts = {(r["gold"], r["pred"]): r["n"] for r in rows.select("gold", pred.alias("pred")).groupBy("gold", "pred").agg(F.count("*").alias("n")).collect()}  # labels squared rows
        total = 0.0
        for t in tags:
            tp = counts.get((t, t), 0)
            wrong = sum(n for (g, p), n in counts.items() if (g == t) != (p == t))
            total += 2 * tp / (2 * tp + wrong) if tp or wrong else 0.0
        return total / len(tags)

    kept: dict[int, float] = {}
    best, out = f1(kept), []
    for tag in tags:
        if tag in candidates:
            score = f1(kept | {tag: candidates[tag]})
            if score - best >= least:
                kept[tag], best = candidates[tag], score
                out.append((tag, candidates[tag], score))
    return out
