"""A Python function over many sets of arguments, each call in a Spark task."""

from __future__ import annotations

import threading
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import SparkSession


def fan_out(
    spark: SparkSession,
    function: Callable,
    args: Sequence[Sequence] | None = None,
    kwargs: Sequence[Mapping] | None = None,
    tasks: int | None = None,
    in_order: bool = True,
    timeout: float | None = None,
) -> list:
    """Results of function for each set of arguments; tasks=0 calls it here, one after another.

    Results come to the driver, so they should be small; write large ones from the call. A call that fails
    fails the job; a timeout in seconds cancels it and raises TimeoutError.
    """
    if args is None and kwargs is None:
        raise ValueError("give args, kwargs or both")
    args = [()] * len(kwargs) if args is None else args
    kwargs = [{}] * len(args) if kwargs is None else kwargs
    if len(args) != len(kwargs):
        raise ValueError(f"there are {len(args)} args and {len(kwargs)} kwargs")
    calls = list(enumerate(zip(args, kwargs, strict=True)))
    if tasks == 0 or not calls:
        return [function(*a, **k) for _, (a, k) in calls]
    sc = spark.sparkContext
    slots = sc.defaultParallelism
    if tasks is not None and tasks < 0:
        if (tasks := slots + tasks) <= 0:
            raise ValueError("fewer tasks than one are left")
    group = f"fan-out-{threading.get_ident()}"
    sc.setJobGroup(group, "fan-out", interruptOnCancel=True)
    timer = threading.Timer(timeout, sc.cancelJobGroup, [group]) if timeout else None
    try:
        if timer:
            timer.start()
        rows = sc.parallelize(calls, min(len(calls), tasks or len(calls))).map(lambda c: (c[0], function(*c[1][0], **c[1][1]))).collect()
    except Exception as e:
        if timer and not timer.is_alive():
            raise TimeoutError(f"the calls took more than {timeout} s") from e
        raise
    finally:
        if timer:
            timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
    return [r for _, r in (sorted(rows, key=lambda x: x[0]) if in_order else rows)]
