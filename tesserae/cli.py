"""Command line: convert, simplify-seurat, formats, inspect, validate."""

from __future__ import annotations

import argparse
import json
import sys

from tesserae import api
from tesserae.functions import hints
from tesserae.model import CELL
from tesserae.operators import check, compare, diagnose, transform
from tesserae.sources import bundle, registry


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.getOrCreate()


def _format(known: registry.Registry, path: str, name: str | None) -> registry.Format:
    found = known.get(name) if name else known.detect(path)
    if found is None:
        raise SystemExit(f"the format of {path} is not known; give one of {', '.join(known.list())}")
    return found


def convert(a: argparse.Namespace, known: registry.Registry) -> int:
    """Read, clean, normalise, select, replace identifiers, write; then compare if asked for. Transforms apply to equal formats as well."""
    source, target, spark = _format(known, a.input, a.input_format), _format(known, a.output, a.output_format), _session()
    ds = source.read(spark, a.input)
    if a.dry_run:
        print(json.dumps({"cells": ds.dims.n_cells, "genes": ds.dims.n_genes, "changes": diagnose.preview(ds), "score": diagnose.score(diagnose.issues(ds))}))
        return 0
    ds = ds if a.keep_names else diagnose.clean(ds)
    ds = transform.normalise(ds, layers=True) if a.normalize else ds
    ds = transform.select_top_genes(ds, a.top_genes) if a.top_genes else ds
    ds = transform.use_gene_ids(ds, a.gene_id_column) if a.gene_id_column else ds
    target.write(ds, a.output)
    if a.validate:
        report = compare.compare(ds, target.read(spark, a.output))
        print(report.summary())
        return int(not report.passed)
    return 0


def inspect(a: argparse.Namespace, known: registry.Registry) -> int:
    source, spark = _format(known, a.input, a.input_format), _session()
    ds = source.read(spark, a.input)
    found = diagnose.issues(ds)
    out = {"format": source.name, "cells": ds.dims.n_cells, "genes": ds.dims.n_genes, "nnz": ds.x.count(), "obs": ds.obs.columns, "var": ds.var.columns, "layers": sorted(ds.layer_dims), "score": diagnose.score(found), "issues": [i.__dict__ for i in found]}
    print(json.dumps(out, indent=1))
    return 0


def validate(a: argparse.Namespace, known: registry.Registry) -> int:
    spark = _session()
    one, other = (_format(known, p, None).read(spark, p) for p in (a.original, a.converted))
    report = compare.compare(one, other, a.tolerance)
    print(report.summary())
    good = report.passed
    if a.cluster_column:
        labels = one.obs.select(CELL, a.cluster_column).toDF(CELL, "a").join(other.obs.select(CELL, a.cluster_column).toDF(CELL, "b"), CELL)
        print(json.dumps(compare.label_agreement(labels, "a", "b").first().asDict()))
    if a.schema:
        result = check.schema(one, a.schema)
        print(json.dumps({"schema": result.version, "passed": result.passed, "missing_obs": result.missing_obs, "missing_var": result.missing_var, "message": result.message}))
        good = good and result.passed
    return int(a.strict and not good)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tesserae", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert")
    c.add_argument("input"), c.add_argument("output")
    c.add_argument("--input-format"), c.add_argument("--output-format"), c.add_argument("--gene-id-column")
    c.add_argument("--normalize", action="store_true"), c.add_argument("--top-genes", type=int), c.add_argument("--keep-names", action="store_true")
    c.add_argument("--validate", action="store_true"), c.add_argument("--dry-run", action="store_true")
    q = sub.add_parser("simplify-seurat")
    q.add_argument("input"), q.add_argument("output")
    sub.add_parser("formats")
    i = sub.add_parser("inspect")
    i.add_argument("input"), i.add_argument("--input-format")
    v = sub.add_parser("validate")
    v.add_argument("original"), v.add_argument("converted")
    v.add_argument("--tolerance", type=float, default=1e-7), v.add_argument("--cluster-column"), v.add_argument("--schema"), v.add_argument("--strict", action="store_true")
    a, known = p.parse_args(argv), registry.default()
    if a.command == "formats":
        for n in known.list():
            print(n, *known.get(n).extensions, known.get(n).description)
        return 0
    if a.command == "simplify-seurat":
        simplified = api.simplify_seurat(_session(), a.input, a.output)
        print(json.dumps({"cells": simplified.dims.n_cells, "genes": simplified.dims.n_genes}))
        return 0
    try:
        return {"convert": convert, "inspect": inspect, "validate": validate}[a.command](a, known)
    except (ValueError, KeyError, OSError, NotImplementedError) as e:
        print(hints.explained(e), file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
