"""Observed heading profiles against a plain walk over the histories."""

import random

import pytest

from roadtrace.operators import profiles


def _plain(turn, path, yaw):
    _, start, now, speed = turn
    past = [p for p in path if p[0] <= now]
    if not past or not yaw:
        return None
    first, last, speed = past[0], past[-1], max(0.0, speed)

    def time_at(d):
        if d < first[1]:
            # By rounding alone, where the profile reaches back to the history's first row.
            return first[0] if d > first[1] - 1e-9 else None
        if d >= last[1]:
            return min(now, last[0])
        i = next(k for k, p in enumerate(past) if p[1] >= d)
        if i == 0:
            return past[0][0]
        a, b = past[i - 1], past[i]
        return a[0] + (b[0] - a[0]) * (d - a[1]) / (b[1] - a[1])

    if first[0] > start:
        since = speed * max(0.0, now - start)
    else:
        at = last[1]
        for i, p in enumerate(past):
            if p[0] >= start:
                at = p[1]
                if i:
                    a = past[i - 1]
                    at = a[1] + (p[1] - a[1]) * (start - a[0]) / (p[0] - a[0])
                break
        since = max(0.0, last[1] - at) + speed * max(0.0, now - max(start, last[0]))
    here = last[1] + speed * max(0.0, now - last[0])
    span = min(2000.0, since + 40, here - first[1])
    while span > 20 and (t := time_at(here - span)) is not None and t < yaw[0][0]:
        span -= 20
    if span < 20:
        return None
    count = int(min(80, max(8, int(span / 5 + 0.5))))
    out = []
    for i in range(count + 1):
        back = span * (1 - i / count)
        t = time_at(here - back)
        if t is None or (i == 0 and t < yaw[0][0]):
            return None
        out.append((i, back, sum(r * (min(t, e) - s) for s, e, r in yaw if s < t), since))
    return out


def test_observed_profiles(spark):
    rnd = random.Random(11)
    turns, travel, yaw, wanted = [], [], [], {}
    for drive in range(6):
        t, d, path = rnd.uniform(0, 5), rnd.uniform(0, 50), []
        for _ in range(rnd.randint(40, 150)):
            path.append((t, d))
            t += rnd.choice([0.5, 1.0, 2.0])
            d += 0.0 if rnd.random() < 0.15 else rnd.uniform(0.3, 22)
        s, own = path[0][0] + rnd.choice([0.0, 11.3, 37.7]), []
        while s < t + 5:
            e = s + rnd.choice([0.2, 0.7, 3.0])
            own.append((s, e, rnd.uniform(-0.3, 0.3)))
            s = e + (rnd.random() if rnd.random() < 0.1 else 0)
        travel += [(drive, *p) for p in path]
        yaw += [(drive, *y) for y in own]
        for turn in range(12):
            start = rnd.uniform(path[0][0] - 3, t)
            row = (turn, start, start + rnd.uniform(0.5, 25), rnd.choice([-1.0, 0.0, 8.0, 15.0]))
            turns.append((drive, *row))
            if (want := _plain(row, path, own)) is not None:
                wanted[drive, turn] = want
    turns.append((99, 0, 1.0, 2.0, 3.0))
    frame = spark.createDataFrame
    out = profiles.observed_profiles(frame(turns, "drive long, turn long, start double, now double, speed double"), frame(travel, "drive long, time double, distance double"), frame(yaw, "drive long, time double, end double, rate double"), "drive", time_bucket=7.0, distance_bucket=90.0)
    got = {}
    for r in out.collect():
        got.setdefault((r["drive"], r["turn"]), []).append((r["place"], r["distance"], r["heading"], r["since_start"]))
    assert len(wanted) > 30 and got.keys() == wanted.keys()
    for k, want in wanted.items():
        for a, b in zip(sorted(got[k]), want, strict=True):
            assert a == pytest.approx(b, abs=1e-9), k
