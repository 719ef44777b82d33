"""Plug-ins are found in folders, packages and entry points."""

import sys

import pytest

from evalloom import registry


@pytest.fixture
def path(tmp_path, monkeypatch):
    monkeypatch.setattr(sys, "path", list(sys.path))
    before = set(sys.modules)
    yield tmp_path
    for name in set(sys.modules) - before:
        if name.startswith("found_"):
            del sys.modules[name]
    for kind in (registry.benchmarks, registry.positional_methods):
        for name in [n for n in kind._items if n.startswith("found")]:
            del kind._items[name]
        kind._names = [n for n in kind._names if not n.startswith("found")]


def test_a_plug_in_dropped_into_a_folder_is_registered(path):
    (path / "found_one.py").write_text("from evalloom.registry import benchmarks\n@benchmarks.register('Found_A', ['found_alias'])\nclass A: pass\n")
    (path / "found_bad.py").write_text("import no_such_library\n")
    (path / "_found_private.py").write_text("raise ValueError\n")
    failed = registry.discover(folder=path)
    assert registry.benchmarks.get("FOUND_a") is registry.benchmarks.get("found_alias") and "found_a" in registry.benchmarks.names()
    assert list(failed) == ["found_bad"] and "no_such_library" in str(failed["found_bad"])
    assert list(registry.discover(folder=path)) == ["found_bad"]


def test_modules_below_a_package_and_entry_points(path, monkeypatch):
    sys.path.insert(0, str(path))
    inner = path / "found_package" / "inner"
    inner.mkdir(parents=True)
    (path / "found_package" / "__init__.py").write_text("")
    (inner / "__init__.py").write_text("")
    (inner / "b.py").write_text("from evalloom.registry import positional_methods\npositional_methods.register('found_b')(lambda x: x)\n")
    (path / "found_entry.py").write_text("from evalloom.registry import positional_methods\npositional_methods.register('found_c')(lambda x: x)\n")

    class Entry:
        module = "found_entry"

    monkeypatch.setattr(registry, "entry_points", lambda group: [Entry()] if group == registry.GROUP else [])
    assert registry.discover("found_package") == {}
    assert {"found_b", "found_c"} <= set(registry.positional_methods.names())
    assert list(registry.discover("found_nowhere")) == ["found_nowhere"]
    (path / "found_twice.py").write_text("from evalloom.registry import positional_methods\npositional_methods.register('FOUND_B')(lambda x: 0)\n")
    assert "registered already" in str(registry.discover(folder=path)["found_twice"])
