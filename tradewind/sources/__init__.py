"""Tables, domain views, feeds and sinks."""
