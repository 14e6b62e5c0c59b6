"""tarn: a Spark-first engine for note, document and telemetry collections."""
