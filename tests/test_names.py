import pytest

from strata.errors import ConfigurationError
from strata.names import AlgorithmName, LayerPath, Selector, TypeTag, cell_text, normal_cell_text


def test_cell_text():
    assert cell_text([], []) == "[]"
    assert cell_text(["run", "subrun"], [0, 5]) == "[run:0, subrun:5]"
    assert cell_text([""], [10]) == "[10]"


def test_algorithm_names():
    assert str(AlgorithmName.parse("plugin:algorithm")) == "plugin:algorithm"
    assert AlgorithmName.parse("a").plugin == ""
    for bad in ("plugin:", "a b", "", "a-b"):
        with pytest.raises(ConfigurationError):
            AlgorithmName.parse(bad)
    n = AlgorithmName.parse("p:a")
    assert n.matches("p") and n.matches("a") and n.matches("p:a") and not n.matches("x")


def test_layer_paths():
    p = LayerPath("run/event")
    assert str(p) == "/job/run/event" and p.depth == 2 and p.parent == LayerPath("job/run")
    assert p.ends_with("event") and p.ends_with("run/event") and not p.ends_with("run")
    assert p.is_under(LayerPath("job")) and not p.is_under(p)
    with pytest.raises(ConfigurationError, match="Layer paths cannot be empty"):
        LayerPath([])
    with pytest.raises(ConfigurationError, match="Layer paths may only contain 'job' as the first element"):
        LayerPath(["job", "run", "job"])
    with pytest.raises(ConfigurationError):
        LayerPath("/run")


def test_type_tags():
    i, f, c = TypeTag("int"), TypeTag("float"), TypeTag("char")
    assert str(TypeTag.list_of(f)) == "LIST float"
    assert str(TypeTag.list_of(TypeTag("unsigned int"))) == "LIST unsigned int"
    s = TypeTag.struct_of(i, i, c, i)
    assert str(s) == "STRUCT {int, int, char, int}"
    assert str(TypeTag.list_of(s)) == "LIST STRUCT {int, int, char, int}"
    assert TypeTag("long") != TypeTag("long long")


def test_selectors():
    with pytest.raises(ConfigurationError, match="Cannot specify product with empty creator name."):
        Selector("job", "")
    with pytest.raises(ConfigurationError, match="Cannot specify the empty string as a data layer."):
        Selector("", "a")
    s = Selector.from_config({"creator": "tracks_alg", "suffix": "tracks", "layer": "job"})
    assert (s.creator, s.suffix, s.layer) == ("tracks_alg", "tracks", "job")
    for bad in ({"creator": 16, "layer": "job"}, {"creator": "a"}, 3):
        with pytest.raises(ConfigurationError):
            Selector.from_config(bad)
    assert Selector("job", "a").agrees(Selector("job", "a", "x")) and not Selector("job", "a").agrees(Selector("run", "a"))


@pytest.mark.parametrize("text", ["[event:1, segment:2]", "[SEGMENT=2; Event=1]", " [ event = 1 ; segment:2 ] "])
def test_normal_cell_text(text):
    assert normal_cell_text(text) == (("event", 1), ("segment", 2))


@pytest.mark.parametrize("text", ["event:1", "[event:x]", "[event 1]"])
def test_malformed_cell_text(text):
    with pytest.raises(ValueError):
        normal_cell_text(text)
