"""The JSON files of graph, users and facts are of bounded size."""

import json
from pathlib import Path

import pytest
from compare import differences

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["graph_from_json", "users_from_json",
                                  "facts_from_objects"])
def test_files_grow_in_number_not_in_size(spark, sf, tmp_path, monkeypatch, name):
    monkeypatch.setattr(entry, "_FILE_ROWS", 20, raising=False)
    monkeypatch.setattr(entry, "_OBJECTS", 20, raising=False)
    monkeypatch.setattr(entry, "scratch_path", lambda spark, label: str(tmp_path / label))
    found = entry.queries()[name](spark, sf)
    assert differences(found, entry.oracle_sql()[name], sf) is None
    sizes = []
    for path in tmp_path.rglob("part-*"):
        text = path.read_text()
        if name == "facts_from_objects":
            sizes.append(text.count('"fact_id"'))
        else:
            held = json.loads(text)
            sizes += [len(held)] if name == "users_from_json" else [
                len(held.get(part, [])) for part in ("nodes", "edges")]
    assert sum(sizes) > 20 and max(sizes) <= 60
