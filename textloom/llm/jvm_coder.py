"""The coder of `context_mixing` as functions that executors run without Python: `ContextMixing.java`, compiled on the driver by
the compiler that Spark bundles for its generated code, and given to executors as a jar of the session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: Classes of the functions, and what they return.
CLASSES = {"Pack": "binary", "Unpack": "binary", "Documents": "array<struct<start:bigint,ids_crc32:bigint>>"}
#: The loader of the classes, their jar and its folder, by application.
_COMPILED: dict[str, tuple] = {}


def _compiled(context: SparkContext) -> tuple:
    if context.applicationId not in _COMPILED:
        compiler = context._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(context._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(Path(__file__).with_name("ContextMixing.java").read_text())
        folder = tempfile.TemporaryDirectory(prefix="textloom-", ignore_cleanup_errors=True)
        # A path that means the same to the JVM.
        jar = os.path.join(os.path.realpath(folder.name), "context-mixing.jar")
        code = compiler.getBytecodes()
        with zipfile.ZipFile(jar, "w", zipfile.ZIP_DEFLATED) as out:
            for name in code.keySet():
                out.writestr(f"{name.replace('.', '/')}.class", bytes(code.get(name)))
        _COMPILED[context.applicationId] = compiler.getClassLoader(), jar, folder
    return _COMPILED[context.applicationId]


def function(spark: SparkSession, name: str, *columns: str | Column) -> Column:
    """A call of one of CLASSES, known to the session from now on."""
    context = spark.sparkContext
    loader, jar, _ = _compiled(context)
    known = f"textloom_{name.lower()}"
    if not spark.catalog.functionExists(known):
        spark.sql(f"ADD JAR '{jar}'").collect()
        nothing = context._gateway.new_array(context._jvm.java.lang.Object, 0)
        made = loader.loadClass(f"textloom.ContextMixing${name}").getDeclaredConstructors()[0].newInstance(nothing)
        spark._jsparkSession.udf().register(known, made, spark._jsparkSession.parseDataType(DataType.fromDDL(CLASSES[name]).json()))
    return F.call_function(known, *columns)
