"""Sequential allocation whose steps depend on one another.

These rules change shared state cell by cell, so a group (a country, a scenario)
is one unit of work in ``applyInPandas``; groups run in parallel.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def allocate_classes(cells: DataFrame, goals: DataFrame, group: str = "zone", step: int = 10) -> DataFrame:
    """Land-use change of several classes at once.

    ``cells``: group, cell, class, target, score - a row a cell and target class, with the class the
    cell has now and how well it suits the target.  ``goals``: group, class, net - cells to gain or
    lose; classes without a goal (or with 0) are free.  Classes take turns of ``step`` ranks.  A growing
    class walks its ranking from the top and takes unchanged cells of classes that must shrink or are
    free; its donor's own walk moves back one rank.  A shrinking class walks its ranking from the
    bottom and gives each of its unchanged cells to the class with the best score: its goal (a
    free class: its size) divided by the cell's rank in it; only classes that still have to grow, or
    are free, can win.  Ends when the goals are met or no walk has ranks left.  Result: group, cell, class.
    """
    kind = dict(cells.dtypes)[group]

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({group: [], "cell": [], "class": []}).astype({"cell": "int64", "class": "int64"})
        before = {int(c): int(k) for c, k in zip(left["cell"], left["class"], strict=True)}
        ranked = {int(t): p.sort_values(["score", "cell"], ascending=[False, True])["cell"].astype(int).tolist() for t, p in left.groupby("target")}
        rank = {t: {c: i + 1 for i, c in enumerate(order)} for t, order in ranked.items()}
        classes = sorted(set(ranked) | set(before.values()))
        goal = dict.fromkeys(classes, 0) | {int(c): int(n) for c, n in zip(right["class"], right["net"], strict=True)}
        size = {c: sum(k == c for k in before.values()) for c in classes}
        net, after = dict(goal), {}
        place = {c: 0 if goal[c] > 0 else len(ranked.get(c, ())) - 1 for c in goal}

        def weight(c: int) -> float:
            return float(goal[c]) if goal[c] > 0 else float(size.get(c, 0)) if goal[c] == 0 else 0.0

        busy = True
        while busy and any(net[c] for c in goal if goal[c]):
            busy = False
            for c in sorted(goal):
                own = ranked.get(c, [])
                for _ in range(min(step, abs(net[c])) if goal[c] and net[c] * goal[c] > 0 else 0):
                    if not 0 <= place[c] < len(own):
                        break
                    busy = True
                    cell = own[place[c]]
                    now = before[cell]
                    if goal[c] > 0:
                        place[c] += 1
                        if cell not in after and now != c and (net[now] < 0 or goal[now] == 0):
                            after[cell] = c
                            net[c] -= 1
                            net[now] += 1
                            place[now] -= goal[now] < 0
                    else:
                        place[c] -= 1
                        if cell not in after and now == c:
                            able = [(weight(k) / rank[k][cell], -k) for k in ranked if k != c and cell in rank[k] and weight(k) > 0 and (goal[k] == 0 or net[k] > 0)]
                            if able:
                                new = -max(able)[1]
                                after[cell] = new
                                net[c] += 1
                                net[new] -= net[new] > 0
        return pd.DataFrame({group: key[0], "cell": list(before), "class": [after.get(c, k) for c, k in before.items()]})

    return cells.groupBy(group).cogroup(goals.groupBy(group)).applyInPandas(run, f"{group} {kind}, cell long, class long")


def allocate_sectors(cells: DataFrame, demand: DataFrame, group: str = "zone", least_share: float = 0.0) -> DataFrame:
    """Demands of several sectors met from one stock of land.

    ``cells``: group, cell, land (share that is free), sector, score, output (of a fully used cell).
    ``demand``: group, sector, amount.  Sectors take turns; each uses the best cell that it has not
    used, all of the land left there if its demand needs it, else the share that it needs.  Shares below
    ``least_share`` are not used.  Result: group, sector, cell, share, output.
    """
    kind = dict(cells.dtypes)[group]

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        land = left.drop_duplicates("cell").set_index("cell")["land"].astype(float).to_dict()
        want = {s: float(a) for s, a in zip(right["sector"], right["amount"], strict=True)}
        queue = {s: p.sort_values(["score", "cell"], ascending=[False, True])[["cell", "output"]].to_numpy().tolist() for s, p in left.groupby("sector")}
        at, out = dict.fromkeys(queue, 0), []
        active = [s for s in sorted(want) if s in queue and want[s] > 0]
        while active:
            for s in list(active):
                while at[s] < len(queue[s]):
                    cell, per = queue[s][at[s]]
                    at[s] += 1
                    share = min(land[cell], want[s] / per if per > 0 else 0.0)
                    if per > 0 and share > 0 and share >= least_share:
                        land[cell] -= share
                        want[s] -= share * per
                        out.append((key[0], int(s), int(cell), share, share * per))
                        break
                else:
                    active.remove(s)
                    continue
                if want[s] <= 1e-12:
                    active.remove(s)
        return pd.DataFrame(out, columns=[group, "sector", "cell", "share", "output"])

    return cells.groupBy(group).cogroup(demand.groupBy(group)).applyInPandas(run, f"{group} {kind}, sector long, cell long, share double, output double")
