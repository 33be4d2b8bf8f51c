import datetime as dt
import os
import random

import numpy as np
import pytest
from gyre.streaming import flows

PIXEL = "series_id long, position long, y int, x int, brightness double, expected int, arrived timestamp"
STATE = "series_id long, position long, state boolean, arrived timestamp"


def source(spark, folder, files, schema):
    """A stream of one micro-batch a file, in the order given."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in-{i}")
        part = next((folder / f"in-{i}").glob("part-*.parquet"))
        (folder / "in").mkdir(exist_ok=True)
        target = folder / "in" / f"{i:03d}.parquet"
        target.write_bytes(part.read_bytes())
        os.utime(target, (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def test_a_table_may_be_a_file_or_a_folder_of_files(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "parts" / "t.parquet"))
    spark.range(10, 20).coalesce(1).write.mode("append").parquet(str(tmp_path / "parts" / "t.parquet"))
    (tmp_path / "one").mkdir()
    part = next((tmp_path / "parts" / "t.parquet").glob("part-*.parquet"))
    (tmp_path / "one" / "t.parquet").write_bytes(part.read_bytes())
    for name, n in (("parts", 20), ("one", 10)):
        seen = []
        stream = flows.table_stream(spark, str(tmp_path / name), "t")
        flows.drain(stream, lambda batch, _: seen.extend(r.id for r in batch.collect()), str(tmp_path / f"out-{name}"))  # noqa: B023
        assert len(seen) == len(set(seen)) == n


def at(second):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)


def expected_map(rows, ratio):
    frames, cells = {}, {}
    for s, p, y, x, v, *_ in rows:
        frames.setdefault((s, p), {})[y, x] = v
    for (s, _), pixels in frames.items():
        cut = np.median(list(pixels.values())) * ratio
        for (y, x), v in pixels.items():
            cells.setdefault((s, y, x), []).append((v, v < cut))
    return {k: (len(v), round(float(np.mean([a for a, _ in v])), 9), float(np.mean([d for _, d in v]))) for k, v in cells.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_a_frame_over_several_files_has_one_median(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(s, p, y, x, rng.random(), 9, None) for s in range(2) for p in range(3) for y in range(3) for x in range(3)]
    want = expected_map(rows, 0.9)
    rows += rows[:4]  # sent twice
    rng.shuffle(rows)
    stream = source(spark, tmp_path, [rows[k::4] for k in range(4)], PIXEL)
    found, late = flows.stream_activity_map(stream, str(tmp_path / "out"), 0.9)
    assert {(r.series_id, r.y, r.x): (r.support_count, round(r["mean"], 9), r.relative_dark_fraction) for r in found.collect()} == want
    assert all((r.series_id, r.position, r.y, r.x) in {x[:4] for x in rows[:]} for r in late.collect())


def test_late_pixels_and_frames_without_a_known_size(spark, tmp_path):
    frame = lambda p, second, n=4: [(1, p, 0, x, float(x + 1), None, at(second)) for x in range(n)]
    files = [frame(0, 0), frame(1, 100, 2), frame(2, 200), [(1, 0, 0, 9, 5.0, None, at(201))], frame(3, 400)]
    stream = source(spark, tmp_path, files, PIXEL)
    found, late = flows.stream_activity_map(stream, str(tmp_path / "out"), 0.9, "10 seconds")
    assert [(r.position, r.x, r.brightness) for r in late.collect()] == [(0, 9, 5.0)]
    counts = {r.x: r.support_count for r in found.collect()}
    assert counts[0] == counts[1] == 3 and counts[2] == counts[3] == 2  # frame 3 is still open


def expected_runs(rows):
    known = {}
    for s, p, state, *_ in rows:
        if state is not None:
            known.setdefault(s, {}).setdefault(p, set()).add(state)
    out = {}
    for s, positions in known.items():
        one = {p: next(iter(v)) for p, v in positions.items() if len(v) == 1}
        longest, flips, length, last = {True: 0, False: 0}, 0, 0, None
        for p in sorted(one):
            touch = last is not None and last == p - 1
            length = length + 1 if touch and one[p] == one[last] else 1
            flips += touch and one[p] != one[last]
            longest[one[p]] = max(longest[one[p]], length)
            last = p
        out[s] = (len(one), flips, longest[True], longest[False])
    return out


def runs(stream, folder, patience=None, chunk=flows.CHUNK):
    found, late = flows.stream_runs(stream, str(folder), patience, chunk)
    return {r.series_id: (r.observed, r.transitions, r.longest_true, r.longest_false) for r in found.collect()}, late.collect()


@pytest.mark.parametrize("seed", [3, 4])
def test_runs_do_not_depend_on_batches_and_arrival(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(s, p, rng.choice([True, True, True, False, None]), None) for s in range(3) for p in range(300) if rng.random() < 0.95]
    rows += [(7, p, True, None) for p in range(50, 250)] + [(8, 5, True, None), (8, 5, False, None), (8, 6, True, None)] + rows[:20]
    want = expected_runs(rows)
    rng.shuffle(rows)
    got, late = runs(source(spark, tmp_path, [rows[k::5] for k in range(5)], STATE), tmp_path / "out", chunk=64)
    assert got == want and late == []


def test_late_positions_of_a_closed_chunk(spark, tmp_path):
    files = [[(1, p, True, at(p)) for p in range(5)], [(2, 0, False, at(300))], [(2, 1, False, at(301)), (1, 5, True, at(302))]]
    got, late = runs(source(spark, tmp_path, files, STATE), tmp_path / "out", "10 seconds")
    assert got == {1: (5, 0, 5, 0), 2: (2, 0, 0, 2)}
    assert [(r.series_id, r.position, r.state) for r in late] == [(1, 5, True)]


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    schema = STATE
    stream = source(spark, tmp_path, [[(1, 0, True, None), (1, 2, True, None)]], schema)
    runs(stream, tmp_path / "out")
    spark.createDataFrame([(1, 1, True, None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got, _ = runs(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), tmp_path / "out")
    assert got == {1: (3, 0, 3, 0)}
