"""Which product an input means."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from strata.errors import ResolutionError
from strata.names import AlgorithmName, Selector
from strata.operators.nodes import Bundle, Node, Producer, Provider, Source


@dataclass(frozen=True)
class ProductRef:
    """One product: the node that makes it and which of its outputs."""

    node: str
    output: int


def _fits(node: Producer, k: int, want: Selector) -> bool:
    if want.suffix is not None and node.suffixes[k] != want.suffix:
        return False
    made = node.types[k]
    return want.type is None or made is None or made == want.type


class Resolver:
    """Looks among the graph's own producers, then explicit providers, then sources."""

    def __init__(self, nodes: dict[str, Node], sources: dict[str, Source]):
        self.nodes, self.sources = dict(nodes), sources
        self.implicit: dict[str, Provider] = {}
        self._by_selector: list[tuple[Selector, ProductRef]] = []

    def resolve(self, want: Selector, consumer: Node) -> ProductRef | None:
        """None if nothing makes it. More than one candidate among the graph's producers, or in the sources, is an error."""
        found = [ProductRef(n.key, k) for n in self.nodes.values() if isinstance(n, Producer) and not isinstance(n, Provider) and n is not consumer for k in range(len(n.suffixes)) if (want.creator is None or n.name.matches(want.creator)) and _fits(n, k, want) and self._made_at(n, want)]
        if len({r.node for r in found}) > 1 or len(found) > 1:
            names = ", ".join(sorted({r.node for r in found}))
            raise ResolutionError(f"Multiple producers found for product {want} required by node '{consumer.key}': {names}")
        if found:
            return found[0]
        for n in sorted((n for n in self.nodes.values() if isinstance(n, Provider)), key=lambda n: n.key):
            named = want.creator is None or AlgorithmName.parse(n.creator).matches(want.creator)
            if named and n.layer == want.layer and (want.stage is None or want.stage == n.stage) and _fits(n, 0, want):
                return ProductRef(n.key, 0)
        return self._from_sources(want, consumer)

    def _made_at(self, node: Producer, want: Selector) -> bool:
        """An in-graph product that states its own layer must be asked for at that layer."""
        layer = getattr(node, "partition", None) or getattr(node, "layer", None)
        return (layer is None or layer == want.layer) and want.stage in (None, "CURRENT")

    def _from_sources(self, want: Selector, consumer: Node) -> ProductRef | None:
        for known, ref in self._by_selector:
            if known == want:
                return ref
        offers: list[tuple[Source, Bundle]] = [(s, b) for s in self.sources.values() for b in s.create_providers(want)]
        if len(offers) > 1:
            raise ResolutionError(f"Multiple implicit providers found for product {want} required by node '{consumer.key}': " + ", ".join(f"{b.creator} of source '{s.name}'" for s, b in offers))
        if not offers:
            return None
        source, b = offers[0]
        key = f"{source.name}[{b.creator}/{b.suffix}/{b.layer}/{b.stage}]"
        if key not in self.implicit:
            node = Provider(AlgorithmName.parse(b.creator), (), (), "serial", (b.suffix,), (b.type,), b.fn, b.layer, b.creator, b.stage)
            node.__dict__["implicit_key"] = key
            self.implicit[key] = node
        self._by_selector.append((want, ProductRef(key, 0)))
        return ProductRef(key, 0)

    def node(self, key: str) -> Node:
        return self.nodes.get(key) or self.implicit[key]

    def resolve_all(self, consumers: Iterable[Node]) -> dict[str, list[ProductRef]]:
        """The products of each consumer's inputs; one error lists everything unmet."""
        out, unmet = {}, []
        for n in consumers:
            refs = [self.resolve(s, n) for s in n.inputs]
            unmet += [(n.key, s) for s, r in zip(n.inputs, refs) if r is None]
            out[n.key] = refs
        if unmet:
            raise ResolutionError("No provider found for the following required products:\n" + "\n".join(f"  - {s} (required by node '{k}')" for k, s in unmet))
        return out
