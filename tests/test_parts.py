import gzip
import os

import numpy as np
import pytest

from strandloom.sources import files


@pytest.mark.parametrize("zipped", [False, True])
def test_parts_by_rank(spark, tmp_path, zipped):
    """Vectors and counts of each rank's words, plain or zipped, with the rank's number of words first."""
    rng = np.random.default_rng(2)
    wi = rng.normal(size=(20, 3)).astype(np.float32)
    model = spark.createDataFrame([(i, wi[i].tolist(), i * 3) for i in range(20) if i != 7], "word long, wi array<float>, wc long").repartition(4)
    files.save_parts(model, str(tmp_path), 20, 3, 3, zipped)
    end = ".gz" if zipped else ""
    names = [f"part_r{r:06d}{x}{end}" for r in range(3) for x in ("", ".wc.txt")]
    assert sorted(f for f in os.listdir(tmp_path)) == sorted(names)
    read = lambda name: (gzip.open if zipped else open)(tmp_path / name, "rb").read()
    words = []
    for r in range(3):
        own = [int(line.split()[0]) for line in read(names[2 * r + 1]).decode().splitlines()]
        assert [int(line.split()[1]) for line in read(names[2 * r + 1]).decode().splitlines()] == [3 * w for w in own]
        data = read(names[2 * r])
        assert int.from_bytes(data[:8], "little") == len(own) and len(data) == 8 + len(own) * (8 + 12)
        rows = np.frombuffer(data[8:], np.dtype([("n", "<u8"), ("v", "<f4", (3,))]))
        assert (rows["n"] == 3).all() and np.array_equal(rows["v"], wi[own])
        words += own
    assert words == [w for w in range(20) if w != 7]
    assert [r.wi for r in files.load_vectors(spark, str(tmp_path / names[0])).orderBy("word").collect()] == [wi[w].tolist() for w in words[:7]]
