"""lemmaflow: corpus analytics for sentence/formula datasets on Spark."""
