"""caminho: address geocoding and analytics as lazy Spark DataFrame plans."""
