"""Reference tables and inputs."""
