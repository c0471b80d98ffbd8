"""What to do about an error."""

from __future__ import annotations

#: Kinds of errors that have a hint, in the order in which they are looked for: exception types, words of the message, the hint.
HINTS: tuple[tuple[str, tuple[type, ...], tuple[str, ...], str], ...] = (
    ("file_not_found", (FileNotFoundError,), (), "Check the path, and that every executor reaches it; an absolute path or a URL of the store is safest."),
    ("out_of_memory", (MemoryError,), ("more than one file may have", "numbers are more than"), "The target holds the dataset in memory. Select genes or cells first, or write a bundle, which has no such limit."),
    ("invalid_h5ad", (), ("hdf5", "fractal heap", "newest file format", "chunk tree"), "The file is no HDF5 file that can be read. Inspect it, or have the program that made it write it again with its default settings."),
    ("invalid_rds", (), ("is no dataset", "no matrix in the active assay", "rds"), "The file holds no Seurat or SingleCellExperiment object that can be read. Save the object itself with saveRDS."),
    ("unsupported_format", (), ("is not known", "no way from", "no format"), "Name a format that the command `formats` lists, or use its extension."),
    ("missing_field", (KeyError,), ("has no column", "no component"), "Inspect the file to see which parts and columns it has."),
    ("dimension_mismatch", (), ("has shape", "rows, not", "have", "entries beyond", "has extent"), "obs needs a row for each row of X, var for each column, embeddings a vector for each cell. Inspect the file for the extents of its parts."),
    ("invalid_sparse_matrix", (), ("starts at row", "entries where rows have", "without a shape"), "The index arrays of a sparse matrix disagree. Build the matrix anew from its entries and save it again."),
    ("unsupported_type", (TypeError, NotImplementedError), ("datatype class", "no hdf5 type"), "Cast the column to a number, text, boolean or category before writing."),
    ("validation_failed", (AssertionError,), ("differ", "validation"), "Compare the two files part by part with the command `validate`."),
)


def kind_of(error: BaseException) -> str | None:
    """The first kind whose words the message has or whose type the error is; words count before types."""
    message = str(error).lower()
    for kind, _, words, _ in HINTS:
        if any(w in message for w in words):
            return kind
    return next((kind for kind, types, _, _ in HINTS if types and isinstance(error, types)), None)


def hint(error: BaseException) -> str | None:
    return next((h for kind, _, _, h in HINTS if kind == kind_of(error)), None)


def explained(error: BaseException) -> str:
    """The message, and on a line of its own what to do about it, if anything is known."""
    found = hint(error)
    return f"{error}\n\nHint: {found}" if found else str(error)
