"""Rolling hashes in steps."""

import numpy as np
import pytest

from wordloom.llm import common


@pytest.mark.parametrize("width", [1, 7, 13])
@pytest.mark.parametrize("n", [0, 1, 12, 13, common.ROLL_STEP - 1, common.ROLL_STEP + 12, common.ROLL_STEP + 13, 2 * common.ROLL_STEP + 100])
def test_windows_do_not_depend_on_their_place(n: int, width: int) -> None:
    rows = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
    found = common.rolling(rows, width)
    assert found.dtype == np.uint64 and len(found) == max(0, n - width + 1)
    places = [i for i in (0, 5, common.ROLL_STEP - 1, common.ROLL_STEP, len(found) - 1) if 0 <= i < len(found)]
    for i in places:
        assert found[i] == common.rolling(rows[i : i + width], width)[0]
    assert len(np.unique(found)) == len(found)


def test_powers_stay_small() -> None:
    common.rolling(np.arange(3 * common.ROLL_STEP, dtype=np.uint64), 13)
    assert all(len(x) <= 4 * common.ROLL_STEP for pair in common._POWERS.values() for x in pair)
