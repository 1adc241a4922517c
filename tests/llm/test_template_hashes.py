"""The array form of template words against the plain one."""

import pyarrow as pa
import pyarrow.compute as pc

from aeroframe.llm import decontaminate


def test_equal_templates_have_equal_hashes(documents):
    words = {w for t in documents.text.dropna() for w in t.split()} | {"", "...", "5km", "km", "km.", "Éa", "(Paris)", "(paris),", "don't", "\"x\"", "中", "ǅx", "١٢", "-7", "i.e.", "e)", "KM", "min?"}
    words = sorted(words)
    hashes = decontaminate.template_hashes(pa.array(words)).tolist()
    seen = {}
    for w, h in zip(words, hashes, strict=True):
        assert seen.setdefault(decontaminate.template_word(w), h) == h
    assert len(set(seen.values())) == len(seen)


def test_batches_of_texts():
    got, starts = decontaminate.Templates().hashes(pa.array(["a  Bb\t5x", "", " a ", "\n"]))
    one = decontaminate.template_hashes(pa.array(["a", "Bb", "5x", "a"]))
    assert got.tolist() == one.tolist() and starts.tolist() == [0, 3, 3, 4, 4]
    assert decontaminate.template_hashes(pc.cast(pa.array([], pa.string()), pa.string())).tolist() == []
