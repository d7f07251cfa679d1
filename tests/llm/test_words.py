"""Array word splitting and hashing against regular expressions."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from yomisaku.llm import words as w
from yomisaku.llm.common import text_blocks

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aB9 z\t\n\x0b\x1cé漢|-'"), max_size=40)), max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_equal_regex(texts):
    column = pa.array(["before", *texts], pa.string()).slice(1)
    for table, pattern in ((w.NOT_BLANK, r"[^\x20\x09-\x0D]+"), (w.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        found = w.Words(column, table)
        hashes = found.hashes()
        assert len(set(hashes.tolist())) == len({found.raw[s:e].tobytes() for s, e in zip(found.starts, found.ends)})
        for d, text in enumerate(texts):
            want = re.findall(pattern, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
            got = [found.raw[found.starts[i]:found.ends[i]].tobytes().decode() for i in range(found.first[d], found.first[d + 1])]
            assert got == want


def test_hashes_do_not_depend_on_place():
    a = w.Words(pa.array(["x yy zzz", "zzz"]), w.NOT_BLANK).hashes()
    b = w.Words(pa.array(["zzz " * 300_000]), w.NOT_BLANK).hashes()
    assert a[2] == a[3] == b[0] and len(np.unique(b)) == 1 and len(np.unique(a)) == 3


def test_blocks_hold_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (3, 0, 50, 1, 1, 1)] + [None])], names=["text"])
    parts = list(text_blocks(iter([batch, batch.slice(0, 0)]), limit=4))
    assert [r for p in parts for r in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert [p.num_rows for p in parts] == [2, 1, 4]
