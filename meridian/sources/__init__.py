"""meridian.sources"""
