"""quire: a Spark-native engine for annotated text corpora."""

__version__ = "0.1.0"


def ship(spark) -> None:
    """Give the executors this package, once per application, so that they need no copy of their own."""
    import tempfile
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_quire_shipped", False):
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quire-")) / "quire-package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    context.addPyFile(str(target))  # served to the executors by the driver
    context._quire_shipped = True
