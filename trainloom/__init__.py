"""trainloom: event-train analytics and cluster curation as Spark plans."""
