"""meridian.plans"""
