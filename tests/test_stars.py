"""Starred pages in a stream's state: commands over micro-batches and a restart, against a plain replay."""

import random
from collections import defaultdict

from foliomill.streaming.state import COMMANDS, follow_stars


def replay(batches):
    sets, out = defaultdict(set), []
    for batch in batches:
        for owner, seq, action, item in sorted((c for c in batch if c[0] is not None and c[1] is not None), key=lambda c: c[1]):
            mine = sets[owner]
            if action == "clear":
                out += [(owner, seq, k, False) for k in sorted(mine)]
                mine.clear()
            elif item is not None and action in ("add", "remove", "toggle"):
                here = item in mine
                if action in ("add", "toggle") and not here:
                    mine.add(item)
                    out.append((owner, seq, item, True))
                elif action in ("remove", "toggle") and here:
                    mine.discard(item)
                    out.append((owner, seq, item, False))
    return out


def test_stars_over_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(4)
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    batches, seq = [], 0
    for k in range(3):
        batch = []
        for _ in range(60):
            seq += 1
            batch.append((rng.choice(["ann", "bo", "ç"]), seq, rng.choice(["add", "add", "remove", "toggle", "toggle", "clear", "jump"]), rng.choice([1, 2, 3, 4, 5, None])))
        batch += [(None, 1, "add", 1), ("bo", None, "add", 1)]
        rng.shuffle(batch)
        batches.append(batch)
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, COMMANDS).coalesce(1).write.mode("append").parquet(source)
        if n != 1:  # the second and third files are two micro-batches of one run, after a restart
            follow_stars(spark, source, out, checkpoint, files_at_once=1).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == sorted(replay(batches)) and len(got) > 60
    follow_stars(spark, source, out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == len(got)
