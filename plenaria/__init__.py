"""plenaria: corpus analytics for parliamentary speech as Spark DataFrame operators."""
