"""feedlift: ingest a live feed of posts with Spark.

Posts are normalised, encoded as JSON messages, carried by a topic, decoded
against a fixed schema, typed, and appended batch by batch to a table.  Every
transform is a ``DataFrame -> DataFrame`` function of built-in expressions and
runs unchanged on batch and streaming input.
"""
