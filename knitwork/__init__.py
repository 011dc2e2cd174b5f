"""knitwork: entity integration over heterogeneous records, expressed as Spark DataFrame plans."""
