import pytest

pytest.importorskip("xxhash")
