"""tidewheel: analytics over keyed, ordered event streams, expressed as Spark plans."""
