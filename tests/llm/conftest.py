import pyarrow as pa
import pyarrow.parquet as pq
import pytest

#: Columns of the table, and others that the operators use as names of their own.
EXTRA = ["key", "row", "words", "mark", "ids", "label", "bucket"]


@pytest.fixture(scope="session")
def documents(spark, tmp_path_factory):
    """Writes (doc_id, text) rows, with clashing extra columns, as the documents of a new folder, and gives its path."""
    def write(rows, **tables):
        folder = tmp_path_factory.mktemp("tables")
        docs = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()),
                         "lang": pa.array([None] * len(rows), pa.string()), "source": pa.array(["s"] * len(rows), pa.string()),
                         "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64()),
                         **{c: pa.array([7] * len(rows), pa.int32()) for c in EXTRA}})
        pq.write_table(docs, folder / "documents.parquet")
        for name, table in tables.items():
            pq.write_table(table, folder / f"{name}.parquet")
        return str(folder)
    return write
