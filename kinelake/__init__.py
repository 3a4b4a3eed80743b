"""Analytics over multi-camera motion data, declared as Spark plans."""
