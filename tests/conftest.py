import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from weekgrain.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(4, partitions=4, memory="4g", app="tests", **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def panel(spark):
    """Seeded panel: 12 players, 3 seasons, up to 10 weeks with gaps."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    rows = []
    for p in range(12):
        for s in (2018, 2019, 2020):
            for w in range(1, 11):
                if rng.random() < 0.85:
                    t = int(rng.integers(0, 12))
                    rows.append((p, f"Name {p}", ["QB", "RB", "WR", "TE"][p % 4], p % 3, (p + w) % 3, "home" if w % 2 else "away", s, w, t, int(rng.integers(0, 10)),
                                 int(rng.integers(0, t + 1)), int(rng.integers(0, 30)), int(rng.integers(0, 20)), float(rng.integers(0, 300)), float(rng.integers(0, 90)),
                                 float(rng.integers(0, 80)), float(rng.integers(0, 100)), int(rng.integers(0, 2)), int(rng.integers(0, 2)), int(rng.integers(0, 3)),
                                 int(rng.integers(0, 2)), int(rng.integers(0, 3)), int(rng.integers(0, 3)), int(rng.integers(0, 3)), int(rng.integers(5, 60)),
                                 float(np.round(rng.gamma(3.0, 4.0), 1))))
    cols = ("player_id name position team opponent home_away season week targets rushing_attempts receptions passing_attempts completions passing_yards rushing_yards "
            "receiving_yards air_yards rushing_tds receiving_tds passing_tds interceptions rush_inside_10 targets_15_plus redzone_targets snap_count fantasy_points").split()
    return spark.createDataFrame(pd.DataFrame(rows, columns=cols))


def to_rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]
