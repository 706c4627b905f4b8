"""meridian.operators"""
