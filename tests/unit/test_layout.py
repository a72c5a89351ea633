from collections import Counter
from pathlib import Path


def test_no_two_test_files_share_a_name():
    names = Counter(p.name for p in Path(__file__).resolve().parents[1].rglob("test_*.py"))
    assert [n for n, k in names.items() if k > 1] == []
