"""Quality of streams."""
