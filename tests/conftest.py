import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from lucidform.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make(spark):
    """A labelled table from arrays."""
    import numpy as np
    import pandas as pd

    from lucidform.sources.labelled import Labelled

    def build(x, y, names=None, parts=4):
        x = np.asarray(x, dtype=float)
        names = names or [f"x{i}" for i in range(x.shape[1])]
        pdf = pd.DataFrame(x, columns=names)
        pdf["y"] = np.asarray(y).astype("int32")
        pdf["rid"] = [str(i) for i in range(len(pdf))]
        return Labelled(spark.createDataFrame(pdf).repartition(parts), tuple(names))

    return build
