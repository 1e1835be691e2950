"""Bytes that Spark has written to shuffles."""


def moved(spark) -> int:
    context = spark.sparkContext
    store, doubles = context._jsc.sc().statusStore(), context._gateway.new_array(context._jvm.double, 0)
    stages = store.stageList(None, False, False, doubles, context._jvm.java.util.ArrayList())
    return sum(s.shuffleWriteBytes() for s in context._jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages))
