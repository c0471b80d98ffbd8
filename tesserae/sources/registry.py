"""File formats by name and extension."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from tesserae.sources import bundle, h5ad, loom, rds


@dataclass(frozen=True)
class Format:
    """read(spark, path) gives a dataset, write(dataset, path) stores one; detect(path) looks into a file whose extension says nothing."""

    name: str
    extensions: tuple[str, ...]
    read: Callable | None = None
    write: Callable | None = None
    detect: Callable[[str], bool] | None = None
    description: str = ""


class Registry:
    def __init__(self) -> None:
        self._formats: dict[str, Format] = {}

    def register(self, f: Format) -> Format:
        self._formats[f.name] = f
        return f

    def get(self, name: str) -> Format:
        if name not in self._formats:
            raise KeyError(f"no format {name!r}; known: {', '.join(self.list())}")
        return self._formats[name]

    def __contains__(self, name: str) -> bool:
        return name in self._formats

    def list(self) -> list[str]:
        return sorted(self._formats)

    def readable(self) -> list[str]:
        return [n for n in self.list() if self._formats[n].read]

    def writable(self) -> list[str]:
        return [n for n in self.list() if self._formats[n].write]

    def detect(self, path: str) -> Format | None:
        """By the longest extension that fits, then by content."""
        fits = [(len(e), f.name) for f in self._formats.values() for e in f.extensions if path.lower().endswith(e)]
        if fits:
            return self._formats[max(fits)[1]]
        return next((self._formats[n] for n in self.list() if (d := self._formats[n].detect) and d(path)), None)


def default() -> Registry:
    out = Registry()
    out.register(Format("bundle", (".bundle", ".parquet"), bundle.read, bundle.write, description="folder of Parquet tables"))
    out.register(Format("h5ad", (".h5ad", ".h5"), h5ad.read, h5ad.write, h5ad.detect, "annotated matrix in HDF5"))
    out.register(Format("loom", (".loom",), loom.read, loom.write, loom.detect, "Loom file"))
    out.register(Format("seurat", (".rds",), rds.read, lambda ds, path: rds.write(ds, path, "seurat"), rds.detect, "Seurat object"))
    out.register(Format("sce", (".sce.rds",), rds.read, lambda ds, path: rds.write(ds, path, "sce"), description="SingleCellExperiment object"))
    return out
