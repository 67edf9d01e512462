"""`Terms.java` as a function that executors run without Python: compiled on the driver by the compiler that Spark bundles for
its generated code, and given to executors as a jar of the session."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from textloom.functions import rules as R

#: The loader of the class, its jar and the jar's folder, by application.
_COMPILED: dict[str, tuple] = {}


def _compiled(context: SparkContext) -> tuple:
    if context.applicationId not in _COMPILED:
        source = re.sub("@([A-Z_]+)@", lambda m: str(getattr(R, m[1])), Path(__file__).with_name("Terms.java").read_text(encoding="utf-8"))
        compiler = context._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(context._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(source)
        folder = tempfile.TemporaryDirectory(prefix="textloom-", ignore_cleanup_errors=True)
        jar = os.path.join(os.path.realpath(folder.name), "terms.jar")  # a path that means the same to the JVM
        code = compiler.getBytecodes()
        with zipfile.ZipFile(jar, "w", zipfile.ZIP_DEFLATED) as out:
            for name in code.keySet():
                out.writestr(f"{name.replace('.', '/')}.class", bytes(code.get(name)))
        _COMPILED[context.applicationId] = compiler.getClassLoader(), jar, folder
    return _COMPILED[context.applicationId]


def terms(spark: SparkSession, text: Column, min_chars: int = 1, stemmed: bool = True, distinct: bool = False) -> Column:
    """The terms of a text: an element for each raw token, null where its term is not valid, or each term once."""
    name = f"textloom_terms_{min_chars}_{int(stemmed)}_{int(distinct)}"
    if not spark.catalog.functionExists(name):
        context = spark.sparkContext
        loader, jar, _ = _compiled(context)
        spark.sql(f"ADD JAR '{jar}'").collect()
        given = context._gateway.new_array(context._jvm.java.lang.Object, 3)
        given[0], given[1], given[2] = min_chars, stemmed, distinct
        made = loader.loadClass("textloom.Terms").getDeclaredConstructors()[0].newInstance(given)
        spark._jsparkSession.udf().register(name, made, spark._jsparkSession.parseDataType('{"type":"array","elementType":"string","containsNull":true}'))
    return F.call_function(name, text)
