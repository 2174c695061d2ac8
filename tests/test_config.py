import pytest
from conftest import rows

from kotonami.runtime import Folder
from kotonami.sources import config, readers, yaml


def test_yaml():
    text = """---
# a comment
extends: "default"
mapping:
  "xa": "ぁ"   # small
  "#": '＃'
  ":": ："
  gone: null
  "\\\\": "￥"
keys:
  - states: [Composition, "PreComposition"]
    key: [C-S-j, space]
    command: go
  - states: [Conversion]
    key: x
    command: null
list:
- 1
- yes it is
- {a: 1, b: [x, 'y, z']}
"""
    text = text.replace('："', '"："')
    got = yaml.load(text)
    assert got["extends"] == "default" and got["mapping"] == {"xa": "ぁ", "#": "＃", ":": "：", "gone": None, "\\": "￥"}
    assert got["keys"] == [{"states": ["Composition", "PreComposition"], "key": ["C-S-j", "space"], "command": "go"}, {"states": ["Conversion"], "key": "x", "command": None}]
    assert got["list"] == [1, "yes it is", {"a": 1, "b": ["x", "y, z"]}] and yaml.load("") is None
    with pytest.raises(ValueError):
        yaml.load("a: 1\nno key here\n")


def test_config(spark, tmp_path):
    at = str(tmp_path / "c")
    found = config.default_dictionaries(spark, [str(tmp_path / "none"), str(tmp_path)])
    assert found == []
    (tmp_path / "skk").mkdir()
    (tmp_path / "skk" / "SKK-JISYO.L").write_text("")
    found = config.default_dictionaries(spark, [str(tmp_path / "none"), str(tmp_path)])
    assert [(d.encoding, d.usage) for d in found] == [("EucJp", "Normal")] and found[0].path.endswith("skk/SKK-JISYO.L")
    assert config.load(spark, at, dicts=found).engine.dicts == found  # no file: defaults
    c = config.Config(live_conversion=True, engine=config.EngineConfig([config.DictConfig("x", "EucJp", usage="SingleTerm")], False))
    config.save(spark, c, at)
    assert config.load(spark, at) == c
    Folder(spark, at).write("config.yml", "live_conversion: true\nengine:\n  dicts:\n    - path: a\n    - path: b\n      usage: Normal\n")
    got = config.load(spark, at)
    assert got.live_conversion and [(d.path, d.usage) for d in got.engine.dicts] == [("a", "Disabled"), ("b", "Normal")] and got.engine.dict_cache
    with pytest.raises(ValueError):
        config.DictConfig(usage="Other")


def test_tables_with_inheritance(spark, tmp_path):
    (tmp_path / "child.yml").write_text('extends: base\nmapping:\n  "a": "ア"\n  "i": null\n', encoding="utf-8")
    (tmp_path / "base.yml").write_text('mapping:\n  "a": "あ"\n  "i": "い"\n  "u": "う"\n', encoding="utf-8")
    assert readers.load_table(spark, str(tmp_path / "child.yml")) == {"a": "ア", "u": "う"}
    (tmp_path / "k.yml").write_text("extends: kbase\nkeys:\n  - states: [Conversion]\n    key: [space]\n    command: cursor_down\n  - states: [Composition]\n    key: [C-h]\n    command: null\n", encoding="utf-8")
    (tmp_path / "kbase.yml").write_text("keys:\n  - states: [Conversion, Composition]\n    key: [space, C-h]\n    command: erase\n", encoding="utf-8")
    assert rows(readers.load_keymap(spark, str(tmp_path / "k.yml"))) == [("Composition", False, False, "space", "erase"), ("Conversion", False, False, "space", "cursor_down"), ("Conversion", True, False, "h", "erase")]
    with pytest.raises(FileNotFoundError):
        readers.load_table(spark, str(tmp_path / "none.yml"))
