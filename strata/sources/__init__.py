"""Where cells and stored products come from."""

from strata.sources.drivers import CellDriver, Driver, FixedHierarchy, JobDriver, LayerGenerator, SourceDriver, TableDriver
from strata.sources.storage import ProductStore, StoredSource

__all__ = ["CellDriver", "Driver", "FixedHierarchy", "JobDriver", "LayerGenerator", "ProductStore", "SourceDriver", "StoredSource", "TableDriver"]
