"""JVM functions of the subpackage, compiled from java/*.java by the compiler that Spark itself uses for its own plans.

The driver compiles a source once for each Spark context and adds the classes as a jar, which every executor, also one
that starts later, fetches from the driver. No build tool or extra library is needed.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _loader(spark: SparkSession, name: str):
    """A class loader with the compiled classes of java/<name>.java, which the executors have too."""
    context = spark.sparkContext
    known = context.__dict__.setdefault("_stepframe_classes", {})
    if name not in known:
        jvm = context._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
        compiler.cook((Path(__file__).parent / "java" / f"{name}.java").read_text(encoding="utf-8"))
        classes = compiler.getBytecodes()
        target = os.path.join(tempfile.mkdtemp(prefix="stepframe-"), f"stepframe-{name}.jar")
        with zipfile.ZipFile(target, "w") as z:
            for class_name in sorted(classes):
                z.writestr(class_name.replace(".", "/") + ".class", classes[class_name])
        context._jsc.addJar(target)
        known[name] = compiler.getClassLoader()
    return known[name]


def _function(spark: SparkSession, name: str, source: str, *arguments) -> Callable[[Column], Column]:
    """An object of java/<source>.java, made with these (type, value) arguments, as a function from binary to binary."""
    context = spark.sparkContext
    gateway, jvm = context._gateway, context._jvm
    kinds, values = gateway.new_array(jvm.Class, len(arguments)), gateway.new_array(jvm.Object, len(arguments))
    for k, (kind, value) in enumerate(arguments):
        kinds[k], values[k] = kind, value
    made = _loader(spark, source).loadClass(f"stepframe.{source}").getConstructor(kinds).newInstance(values)
    spark._jsparkSession.udf().register(name, made, getattr(jvm.org.apache.spark.sql.types.DataTypes, "BinaryType"))
    return lambda column: F.call_function(name, column)


def token_coder(spark: SparkSession, decode: bool) -> Callable[[Column], Column]:
    """Frames of plain ids to coded frames, or back."""
    flag = spark.sparkContext._jvm.java.lang.Boolean.TYPE
    return _function(spark, "stepframe_tokens_plain" if decode else "stepframe_tokens_coded", "TokenCoder", (flag, decode))


def webp(spark: SparkSession, decode: bool) -> Callable[[Column], Column]:
    """Payloads to media, or media to the pixel arrays of their files."""
    from stepframe.llm.webp_lossless import SHORT

    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    near = gateway.new_array(jvm.int, 2 * len(SHORT))
    for k, (dx, dy) in enumerate(SHORT):
        near[2 * k], near[2 * k + 1] = dx, dy
    flag = jvm.java.lang.Boolean.TYPE
    return _function(spark, "stepframe_webp_read" if decode else "stepframe_webp_write", "WebpLossless", (flag, decode), (near.getClass(), near))
