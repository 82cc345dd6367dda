import pytest

from seqcast import Settings


def test_overrides_take_effect():
    s = Settings().override(epochs=3, symbols=("X",))
    assert (s.epochs, s.symbols) == (3, ("X",))
    assert Settings().epochs == 200


def test_mapping_reaches_the_settings():
    s = Settings.from_mapping({"world_size": 3, "symbols": ["X", "Y"]})
    assert (s.world_size, s.symbols) == (3, ("X", "Y"))
    with pytest.raises(ValueError, match="no_such"):
        Settings.from_mapping({"no_such": 1})


def test_world_size_from_environment_unless_given():
    assert Settings.from_env({"NUM_PROCESSES": "4"}).world_size == 4
    assert Settings.from_env({"NUM_PROCESSES": "4"}, world_size=3).world_size == 3
    assert Settings.from_env({}).world_size == 2


def test_paths_join_on_any_filesystem():
    assert Settings(data_dir="hdfs://host/in/", bars_file="b.csv").bars_path == "hdfs://host/in/b.csv"
    assert Settings(data_dir="/data", bars_file="b.csv").bars_path == "/data/b.csv"


@pytest.mark.parametrize("bad", [{"target": "Price"}, {"train_ratio": 0.9, "val_ratio": 0.1}, {"window": 0}, {"epochs": 0}])
def test_impossible_settings_are_refused(bad):
    with pytest.raises(ValueError):
        Settings(**bad)


def test_values_are_checked_by_kind():
    assert Settings.from_mapping({"symbols": "AES", "learning_rate": 1}).symbols == ("AES",)
    assert Settings(learning_rate=1).learning_rate == 1.0
    for bad in ({"symbols": 3}, {"symbols": []}, {"window": "60"}, {"window": True}, {"dropout": "0.1"}, {"patience": 1.5}, {"data_dir": 1}):
        with pytest.raises(ValueError):
            Settings.from_mapping(bad)
