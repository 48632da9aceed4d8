"""Plain text of a batch is made piece by piece, with the same result."""

import pyarrow as pa

from briefwell.functions import text


def test_plain_text_holds_few_strings_at_once():
    held = []

    class Watched:
        def __init__(self, values):
            self.values = values

        def __len__(self):
            return len(self.values)

        def slice(self, k, n):
            return Watched(self.values.slice(k, n))

        def to_pylist(self):
            held.append(len(self.values))
            return self.values.to_pylist()

    given = [f" a &amp;  b{i}\n" for i in range(1000)]
    assert text._plain(Watched(pa.array(given))).to_pylist() == [f"a & b{i}" for i in range(1000)]
    assert max(held) <= 256
    assert text._plain(pa.array([], pa.string())).to_pylist() == []
