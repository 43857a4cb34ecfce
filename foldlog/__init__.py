"""foldlog: event-log analytics as Spark DataFrame operators."""
