"""Operations of a training-data pipeline, each a Spark job.

Nothing else in the library imports this subpackage.  ``queries`` holds the
thin ``opN_<name>`` callables that ``__spark_entry__`` registers.
"""
