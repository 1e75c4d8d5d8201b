"""Names that exist before any DataFrame does: algorithms, layers, products, selectors."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from strata.errors import ConfigurationError

_NAME = re.compile(r"^[0-9A-Za-z_\[\]]+$")


@dataclass(frozen=True)
class AlgorithmName:
    """``plugin:algorithm`` or ``algorithm``."""

    plugin: str
    algorithm: str

    @classmethod
    def parse(cls, text: str) -> AlgorithmName:
        plugin, colon, algorithm = text.rpartition(":")
        if colon and not algorithm:
            raise ConfigurationError(f"Algorithm name '{text}' ends with a colon")
        for part in (plugin, algorithm) if colon else (algorithm,):
            if not _NAME.match(part):
                raise ConfigurationError(f"Algorithm name '{text}' has characters other than letters, digits, '_', '[' and ']'")
        return cls(plugin, algorithm)

    def matches(self, creator: str) -> bool:
        """A creator may name the plugin, the algorithm, or both."""
        return creator in (self.plugin, self.algorithm, str(self)) and creator != ""

    def __str__(self) -> str:
        return f"{self.plugin}:{self.algorithm}" if self.plugin else self.algorithm


class LayerPath(tuple):
    """Names of the layers from ``job`` down."""

    def __new__(cls, names="job"):
        if isinstance(names, str):
            if names.startswith("/") and not (names + "/").startswith("/job/"):
                raise ConfigurationError(f"Layer path '{names}' must start with 'job' after the leading '/'")
            names = [n for n in names.split("/") if n]
        names = tuple(names)
        if not names:
            raise ConfigurationError("Layer paths cannot be empty")
        if any(n == "" for n in names):
            raise ConfigurationError("Layer names cannot be empty")
        if "job" in names[1:]:
            raise ConfigurationError("Layer paths may only contain 'job' as the first element")
        return super().__new__(cls, names if names[0] == "job" else ("job", *names))

    @property
    def name(self) -> str:
        return self[-1]

    @property
    def depth(self) -> int:
        return len(self) - 1

    @property
    def parent(self) -> LayerPath | None:
        return LayerPath(self[:-1]) if len(self) > 1 else None

    @property
    def keys(self) -> tuple[str, ...]:
        """One key column for each layer but the job; a repeated name is numbered."""
        out: list[str] = []
        for n in self[1:]:
            k = f"k_{n}"
            out.append(k if k not in out else f"{k}_{len(out)}")
        return tuple(out)

    def child(self, name: str) -> LayerPath:
        return LayerPath((*self, name))

    def is_under(self, other: LayerPath) -> bool:
        """Strictly below ``other``."""
        return len(self) > len(other) and self[: len(other)] == tuple(other)

    def ends_with(self, text: str) -> bool:
        """Whether ``text``, a name or a partial path, is its tail."""
        tail = tuple(n for n in text.split("/") if n)
        return tuple(self[-len(tail) :]) == tail and (not text.startswith("/") or len(tail) == len(self))

    def __str__(self) -> str:
        return "/" + "/".join(self)


#: Type tags by their kind; lists and structures are built from these.
KINDS = ("void", "bool", "char", "unsigned char", "short", "unsigned short", "int", "unsigned int", "long", "unsigned long", "long long", "unsigned long long", "float", "double", "string")


@dataclass(frozen=True)
class TypeTag:
    """A kind with its flags. Unknown types have the exact name and equal only themselves."""

    kind: str
    is_list: bool = False
    children: tuple[TypeTag, ...] = ()

    @classmethod
    def list_of(cls, element: TypeTag) -> TypeTag:
        return cls(element.kind, True, element.children)

    @classmethod
    def struct_of(cls, *fields: TypeTag) -> TypeTag:
        return cls("struct", False, fields)

    def __str__(self) -> str:
        inner = "STRUCT {" + ", ".join(map(str, self.children)) + "}" if self.kind == "struct" else self.kind
        return f"LIST {inner}" if self.is_list else inner


@dataclass(frozen=True)
class Selector:
    """What an input asks for. ``layer`` is needed; ``creator``, ``suffix``, ``stage`` and ``type`` narrow it."""

    layer: str
    creator: str | None = None
    suffix: str | None = None
    stage: str | None = None
    type: TypeTag | None = None
    #: Whether the function gets a structure of the cell's keys and the ``value``, rather than the value alone.
    handle: bool = field(default=False, compare=False)

    def __post_init__(self):
        if self.creator == "":
            raise ConfigurationError("Cannot specify product with empty creator name.")
        if not self.layer:
            raise ConfigurationError("Cannot specify the empty string as a data layer.")

    @classmethod
    def from_config(cls, value: dict) -> Selector:
        """From configuration, where the creator is needed as well."""
        if not isinstance(value, dict):
            raise ConfigurationError("A product selector must be a table of names")
        for key in ("creator", "layer"):
            if not isinstance(value.get(key), str):
                raise ConfigurationError(f"Error retrieving parameter '{key}': {'missing' if key not in value else 'not a string'}")
        return cls(value["layer"], value["creator"], value.get("suffix"), value.get("stage"))

    def agrees(self, other: Selector) -> bool:
        """Whether two selectors may mean one product; what either leaves open agrees with anything."""
        return self.layer == other.layer and all(a is None or b is None or a == b for a, b in ((self.creator, other.creator), (self.suffix, other.suffix), (self.stage, other.stage), (self.type, other.type)))

    def __str__(self) -> str:
        of = [f"suffix {self.suffix}"] * bool(self.suffix) + [f"type {self.type}"] * (self.type is not None)
        by = f" by creator {self.creator}" if self.creator else ""
        stage = f" from stage {self.stage}" if self.stage else ""
        return f"'<{', '.join(of) or 'any product'}>'{by} in layer {self.layer}{stage}"


def cell_text(names: list[str], numbers: list[int]) -> str:
    """``[run:0, subrun:5]``; an unnamed layer gives the bare number."""
    return "[" + ", ".join(f"{n}:{k}" if n else str(k) for n, k in zip(names, numbers)) + "]"


def normal_cell_text(text: str) -> tuple[tuple[str, int], ...]:
    """Order-free form of a written index: lower-case names, ``:`` or ``=``, ``,`` or ``;``. Numbers without names get the name ''."""
    body = text.strip()
    if not (body.startswith("[") and body.endswith("]")):
        raise ValueError(f"malformed cell index: {text!r}")
    out = []
    for part in re.split("[,;]", body[1:-1]):
        if not part.strip():
            continue
        m = re.fullmatch(r"\s*(?:([A-Za-z_][A-Za-z0-9_]*)\s*[:=]\s*)?(\d+)\s*", part)
        if not m:
            raise ValueError(f"malformed cell index: {text!r}")
        out.append(((m[1] or "").lower(), int(m[2])))
    return tuple(sorted(out))
