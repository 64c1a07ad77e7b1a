"""Instants written at more than 128 characters."""

import pandas as pd
import pytest

from tidemark.operators import clocks


@pytest.mark.parametrize("n", [1, 7, 40, 400])
def test_length_does_not_matter(n):
    texts = ["2024-01-31T10:00:00.123456" + "7" * n + "Z", "2024-01-31" + " " * n + "10:00:00.123456Z", "2024-01-31T10:00:00.123456Z[" + "A" * n + "]", "2024-01-31T11:00:00.123456+01:00[" + "A" * n + "]", "2024-01-31T10:00:00" + " " * (n + 1) + "Z", "9" * 200 + "x" * n]
    got = clocks.parse_instants(pd.Series(texts), pd.Series(["UTC"] * len(texts)), pd.Series([1] * len(texts)))
    at = 1706695200123456
    assert list(got) == [at, at, clocks.NONE, at, clocks.NONE, clocks.NONE]
