"""driftnet: a literature analytics engine expressed as Spark DataFrame plans."""
