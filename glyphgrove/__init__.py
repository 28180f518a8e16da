"""glyphgrove: structural similarity search and corpus hygiene on Spark.

Layers (each imports only from those above it):

* ``runtime``    table access, durable cuts, spreading
* ``functions``  scalar building blocks: scores, tag escaping, stemming, path canonicalisation
* ``parse``      markup -> canonical tree strings, tree strings -> node arrays
* ``align``      tree alignment and unification, called from one Arrow function
* ``operators``  DataFrame -> DataFrame operators
* ``sources``    readers and writers (documents, topics, tab-separated records, run files)
* ``streaming``  the same operators over Structured Streaming
* ``plans``      named queries over the driver's tables, with their SQL twins

The subpackage ``llm`` holds the operators of a training-data pipeline; nothing
outside it imports it.
"""
