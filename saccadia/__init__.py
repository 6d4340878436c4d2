"""saccadia: Spark-native analytics for pupil-size and gaze recordings."""
